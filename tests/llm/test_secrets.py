import hashlib
import math
import random
import re
from collections import Counter

from stowage.llm.secrets import secrets

SCHEMA = "doc_id bigint, text string, uid int, found string, kind int"
BASE = [
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            value = m[2] if k == 0 else m[0]
            if len(value) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), kind, value))
    return sorted(out)


def brute(rows):
    random_words = {b[4] for _, t in rows for b in base_spans(t)}
    word = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_-]{5,63}(?![A-Za-z0-9+/_=-])")
    seen = Counter(w for _, t in rows for w in word.findall(t or ""))

    def model(words):
        pairs = Counter(p for w in words for p in {w[i:i + 2] for i in range(len(w) - 1)})
        heads = Counter()
        for p, n in pairs.items():
            heads[p[0]] += n
        tails = Counter()
        for p, n in pairs.items():
            tails[p[1]] += n
        return lambda p: (pairs[p] + 5 * (tails[p[1]] + 1) / (sum(pairs.values()) + 67)) / (heads[p[0]] + 5)

    ours, theirs = model(random_words), model([w for w, n in seen.items() if n > 1])

    def score(s):
        total = 0
        for p in (s[i:i + 2] for i in range(len(s) - 1)):
            total += math.log(ours(p)) - math.log(theirs(p))
        return total

    out = []
    for i, t in rows:
        base = base_spans(t)
        spans = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
            if not any(b[0] < m.end() and m.start() < b[2] for b in base) and score(m[0]) > -math.log(1e-5):
                spans.append((m.start(), 3, m.end(), "markov"))
        text = lambda x: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(x))
        n = Counter(s[3] for s in spans)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text(base).encode()).hexdigest(), text(spans), n["markov"]))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(3)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = ["configuration_manager", "responseHandlerFactory", "internationalization", "user_account_settings_page", "plain", "words"]
    parts = ["con", "fig", "ure", "value", "index", "list", "map", "er", "user", "count", "file", "Name", "Path", "_of_", "table", "load"]
    names += ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    out = [(200 + i, f"passwd={key(wide, 30)}") for i in range(30)]
    for i in range(40):
        words = [rng.choice(names) for _ in range(rng.randrange(60))]
        extra = [f"password={key(wide, 12)}", f"Token: '{key(wide, 30)}'", "AKIA" + key("ABCDEFGHIJ0123456789", 16), key("0123456789abcdef", 32), f"é {key(wide, 40)} 😀", "secret=token:abcdefgh", "API_KEY = x", "apikey:\"abc.def-1"]
        words += rng.sample(extra, rng.randrange(len(extra)))
        rng.shuffle(words)
        out.append((i, " ".join(words)))
    return out + [(100, None), (101, ""), (102, "😀" * 5000 + "AKIA" + "A1" * 20), (103, "password=abcdef" * 3000), (104, "password: x"),
                  (1, out[40][1]), (None, "passwd=hunter22"), (None, "passwd=hunter22")]


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in data], SCHEMA)
    found = sorted((tuple(r) for r in secrets(df).collect()), key=repr)
    assert found == brute(data)
    assert sum(r[6] for r in found) > 0


def test_no_python_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = secrets(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_identifiers_are_no_secrets(spark):
    text = " ".join(["configuration_manager_factory responseHandlerFactoryBean"] * 3) + " password=Zx81kq0P3vbn"
    out = secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (out.n_assign, out.n_markov) == (1, 0)
