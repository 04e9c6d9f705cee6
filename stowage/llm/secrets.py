"""Secrets in text: fixed patterns, and random strings told apart by character Markov models. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import whole_text
from stowage.session import cut_lineage

KINDS = ("assign", "access", "hex", "markov")
#: Fixed patterns. Matches of the first are kept when their second group has 6 characters; the lengths of the others
#: are part of their patterns, which finds the same since runs of one class never overlap.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_CHARS = 6
#: What the models judge, and what an ordinary identifier looks like.
CANDIDATE_CHARS = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_-]{5,63}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Weight, in counts, of how frequent a character is at all against how frequent it is after the one before.
BACKOFF = 5.0
#: A candidate is reported when its likelihood ratio outweighs these odds of a random string among candidates.
PRIOR_ODDS = 1e-5


def _found(kind: int, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Matches as (kind, i, gap, length, value): ``gap`` characters lie between the match before and this one."""
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group)) if value_group else matches
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.split("text", pattern, -1).alias("gap"), values.alias("v")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("length"),
            x["v"].alias("value"), (F.length(x["v"]) >= least).alias("good"),
        ),
    )
    # The text behind the last match has no match of its own.
    return F.when(F.col("text").rlike(pattern), F.filter(rows, lambda r: r["length"].isNotNull())).otherwise(F.expr(
        "cast(array() AS array<struct<kind:int,i:int,gap:int,length:int,value:string,good:boolean>>)"))


def matches(docs: DataFrame, text: str = "text", candidate_chars: int = CANDIDATE_CHARS) -> DataFrame:
    """Rows (uid, doc_id, found): one per document, with the matches of all kinds; written once, so uid is stable."""
    rows = docs.select("doc_id", whole_text(text).alias("text")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id",
        F.concat(_found(0, ASSIGN, 2, ASSIGN_CHARS), _found(1, ACCESS), _found(2, HEX), _found(3, CANDIDATE % candidate_chars)).alias("found"),
    )
    return cut_lineage(rows, "matches")


def transitions(words: DataFrame, name: str) -> DataFrame:
    """(pair, n) of the neighbouring characters of all words; a word counts a pair once, so no long one decides."""
    pairs = words.select(F.explode(F.expr("array_distinct(transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, i, 2)))")).alias("pair"))
    return pairs.filter("length(pair) = 2").groupBy("pair").agg(F.count("*").alias(name))


def train(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(pair, ratio): log-likelihood ratio of a character given the one before, random against ordinary.

    Random samples are all values that the fixed patterns find, each once. Ordinary samples are the identifiers of
    all texts that occur more than once, each once: random strings hardly recur. Both models fall back on the
    frequencies of single characters; the table has a row for each pair of the alphabet.
    """
    ordinary = (
        docs.select(F.explode(F.regexp_extract_all(whole_text(text), F.lit(IDENTIFIER), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word")
    )
    random = found.select(F.explode("found").alias("m")).filter("m.kind < 3 AND m.good").select(F.col("m.value").alias("word")).distinct()
    letters = F.array(*map(F.lit, ALPHABET))
    table = (
        docs.sparkSession.range(1).select(F.explode(letters).alias("head"))
        .select("head", F.explode(letters).alias("tail")).select("head", "tail", F.concat("head", "tail").alias("pair"))
    )
    shares = []
    for name, words in (("random", random), ("ordinary", ordinary)):
        pairs = cut_lineage(transitions(words, name), name)
        ends = [pairs.groupBy(F.substring("pair", at, 1).alias(c)).agg(F.sum(name).alias(f"{name}_{c}")) for at, c in ((1, "head"), (2, "tail"))]
        total = pairs.agg(F.sum(name)).first()[0] or 0
        table = table.join(pairs, "pair", "left").join(ends[0], "head", "left").join(ends[1], "tail", "left")
        count = lambda c: F.coalesce(c, F.lit(0))
        single = (count(f"{name}_tail") + 1) / (total + len(ALPHABET))
        shares.append((count(name) + BACKOFF * single) / (count(f"{name}_head") + BACKOFF))
    return cut_lineage(table.select("pair", (F.log(shares[0]) - F.log(shares[1])).alias("ratio")), "transitions")


def secrets(docs: DataFrame, text: str = "text", candidate_chars: int = CANDIDATE_CHARS, prior_odds: float = PRIOR_ODDS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined; ``base_sha256`` is the
    SHA-256 of those of the three fixed patterns. A run of at least ``candidate_chars`` characters that touches none of
    them is reported as markov when its log-likelihood ratio exceeds -log(prior_odds). Null and empty texts have none. Without any
    sample the models agree and nothing is added. Texts are read twice and never shuffled; only matches are.
    """
    found = matches(docs, text, candidate_chars)
    model = train(docs, found, text)
    by_kind = Window.partitionBy("uid", "m.kind").orderBy("m.i")
    placed = (
        found.filter(F.size("found") > 0).select("uid", F.explode("found").alias("m"))
        .withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(by_kind.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("m.good")
        .select("uid", F.col("m.kind").alias("kind"), (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.value").alias("value"))
    )
    order = Window.partitionBy("uid").orderBy("start", "kind", "end")
    fixed = F.col("kind") < 3
    clear = (
        placed.withColumn("before", F.max(F.when(fixed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("after", F.min(F.when(fixed, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
        .filter(fixed | (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
        .select("uid", "kind", "start", "end", "value")
    )
    clear = cut_lineage(clear, "spans")
    scored = (
        clear.filter(~fixed)
        .select("uid", "kind", "start", "end", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
        .join(F.broadcast(model), "pair")
        .groupBy("uid", "kind", "start", "end").agg(F.sum("ratio").alias("score"))
        .filter(F.col("score") > -F.log(F.lit(prior_odds))).select("uid", "kind", "start", "end")
    )
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    label = F.concat_ws(":", name, "start", "end")
    per_doc = (
        clear.filter(fixed).select("uid", "kind", "start", "end").union(scored)
        .groupBy("uid").agg(
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(4)],
            F.sort_array(F.collect_list(F.struct("start", "kind", label.alias("label")))).alias("all"),
        )
    )
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r["label"]), ",")
    per_doc = per_doc.select(
        "uid", *[f"n_{k}" for k in KINDS],
        F.sha2(joined(F.filter("all", lambda r: r["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
    )
    zero = F.lit(0).cast("bigint")
    return found.select("uid", "doc_id").join(per_doc, "uid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:3]],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_markov", zero).alias("n_markov"),
    )
