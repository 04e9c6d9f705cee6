import random
import shutil
import zlib

import numpy as np
import pytest
import tokenizers
from tokenizers import Tokenizer

from stowage.llm import packing
from stowage.llm.packing import best_fit, default_tokenizer, local_search, pack, word_token_ids

SCHEMA = "doc_id bigint, text string, piece string, uid int, g int, offset string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


TEXTS = ["", " ", "Don't STOP  \n\tnow, it'S 12.50€!", "ñandú über ΑΣ Σ ﬁ İ ǅ", "x<|endoftext|>y <|startoftext|>", "á é z q\x85\x1cw", "日本語 テスト 🎉👍",
         "'re 'll' 'd!'s", "ÀÉÎ ß ÿ × ÷ ª º ² ½ µ", "\r\n \x0b\x0c x"]


def test_word_by_word_is_the_tokenizer_itself(tokenizer):
    rng = random.Random(2)
    pool = "abzßéÑ0129.,!'\"<|> \n\t-_/ ́ΣIİ"
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(word_token_ids(t, default_tokenizer()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_common_words_are_encoded_once(tokenizer, monkeypatch, tmp_path):
    asked = []

    class Counted:
        model = property(lambda self: self)

        @staticmethod
        def from_file(path):
            return Counted()

        def tokenize(self, part):
            asked.append(part)
            return tokenizer.model.tokenize(part)

        def encode(self, word, **options):
            asked.append(word)
            return tokenizer.encode(word, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    path = shutil.copy(default_tokenizer(), tmp_path / "other.json")  # nothing of it is remembered yet
    rare = ["".join(p) for p in zip(*[iter(random.Random(7).choices("abcdefgh", k=6 * 900))] * 6)]
    text = " ".join(w for i, r in enumerate(rare) for w in (f"common{'klmnopqrst'[i % 10]}", "日本", r))
    assert np.frombuffer(word_token_ids(text, str(path)), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) <= len(set(text.split())) + 1  # and the empty part


def test_blocks_forget_and_keep_each_text_whole(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 60)
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    texts = [*TEXTS, "", "läuft the 7 " * 30, *reversed(TEXTS), "word", ""]
    found = [np.frombuffer(bytes(i), "<u4").tolist() for i in packing.token_ids(texts, default_tokenizer())]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(packing.token_ids([], default_tokenizer())) == []


def test_every_piece_once_and_no_gaps(spark, tokenizer):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "of", "läuft", "x9"]) for _ in range(rng.choice([1, 30, 500, 900, 3000])))) for i in range(60)]
    docs += [(70 + i, t) for i, t in enumerate(TEXTS)] + [(90, None), (5, docs[5][1]), (None, "null id"), (91, "word " * 30_000)]
    rows = pack(spark.createDataFrame([(*d, "x", 1, 2, "o") for d in docs], SCHEMA), group_rows=40).collect()
    want = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            want.append((str(d), p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 4


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def fills(bins, lengths):
    return sorted(int(lengths[b].sum()) for b in bins)


def test_exchanges_empty_bins():
    lengths = np.array([6, 3, 5, 2, 2, 2])
    one_for_one = local_search(lengths, [[0, 1], [2, 3, 4], [5]], 10)
    assert fills(one_for_one, lengths) == [10, 10] and len(one_for_one) == 2
    lengths = np.array([8, 5, 3, 2, 2])  # 5 for 2 + 2, then 3 + 2 + 2 are left
    assert fills(local_search(lengths, [[0], [2, 3, 4], [1]], 10), lengths) == [10, 10]


def test_search_keeps_all_and_never_worsens():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, 100, rng.integers(1, 80))
        start = best_fit(lengths, 100)
        end = local_search(lengths, start, 100)
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 100 for b in end) and len(end) <= len(start)
        assert (np.array(fills(end, lengths)) ** 2).sum() >= (np.array(fills(start, lengths)) ** 2).sum()
    scattered = [[i] for i in range(200)]
    lengths = rng.integers(20, 60, 200)
    assert len(local_search(lengths, scattered, 100)) <= 1.1 * len(best_fit(lengths, 100))
