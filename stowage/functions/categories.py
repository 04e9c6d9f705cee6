"""Extension to category lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.paths import extension

# The categories in display order and the extensions of each.
CATEGORIES = ("Documents", "Images", "Videos", "Audio", "Installers", "Archives", "Code", "Others")
EXTENSIONS = {
    "Documents": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp csv md epub mobi",
    "Images": "jpg jpeg png gif bmp svg webp ico tiff tif psd ai eps raw cr2 nef heic heif",
    "Videos": "mp4 avi mkv mov wmv flv webm m4v mpeg mpg 3gp vob",
    "Audio": "mp3 wav flac aac ogg wma m4a aiff ape alac mid midi",
    "Installers": "exe msi dmg pkg deb rpm appimage snap flatpak apk ipa",
    "Archives": "zip rar 7z tar gz bz2 xz iso img cab arj lzh",
    "Code": "js ts jsx tsx py java c cpp cc h hpp cs go rs rb php swift kt scala r m mm sql sh bash ps1 bat cmd "
            "html htm css scss sass less json xml yaml yml toml ini cfg conf vue svelte astro",
}
OTHERS = "Others"


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    # VALUES becomes a local relation; createDataFrame would add a Python-fed scan.
    body = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def extension_dim(spark: SparkSession) -> DataFrame:
    """(extension, category), 126 rows."""
    rows = [(f".{e}", c) for c, listed in EXTENSIONS.items() for e in listed.split()]
    return _values(spark, rows, "extension, category")


def category_dim(spark: SparkSession) -> DataFrame:
    """(position, category, extensions), 8 rows in display order."""
    rows = [(i, c, len(EXTENSIONS.get(c, "").split())) for i, c in enumerate(CATEGORIES)]
    return _values(spark, rows, "position, category, extensions")


def extensions_for_category(spark: SparkSession, category: str) -> DataFrame:
    if category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    return extension_dim(spark).filter(F.col("category") == category).select("extension")


def with_category(files: DataFrame, path: Column | str = "file_path") -> DataFrame:
    """Add ``extension`` and ``category``.

    The broadcast side is the fixed dimension above, so its size never grows with the data.
    """
    dim = F.broadcast(extension_dim(files.sparkSession))
    return (
        files.withColumn("extension", extension(path))
        .join(dim, "extension", "left")
        .withColumn("category", F.coalesce("category", F.lit(OTHERS)))
    )
