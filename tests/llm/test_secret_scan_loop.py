"""The secret scan against a plain loop: base spans by Python's re, windows counted anew."""

import collections
import math
import random
import re
import string

from tidemark.llm import secrets
from tidemark.llm.secrets import KINDS, find_secrets, spelled

ALLOWED = [re.compile(p) for p in (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|xxxx", r"0123456789|abcdefghij|(?i:qwertyuiop)",
    r"^[0-9+/_=-]+$", r"^[a-z0-9_-]*(/[a-z0-9_-]*){2,}$")]


def base_spans(t):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                         r"([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t)
            if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t)
            if m.end() - m.start() >= 32]
    return sorted(out)


def bits_of(word):
    window = 20 if len(word) >= 20 else 16
    if re.fullmatch("[0-9a-fA-F]+", word):
        return window, (3.0, 2.75)[window == 16]
    if re.search("[0-9]", word) and re.search("[A-Za-z]", word):
        return window, (3.75, 3.5)[window == 16]
    if re.search("[a-z].*[A-Z]", word):
        return window, (3.85, 3.6)[window == 16]
    return window, 3.7 if re.search("[A-Za-z]", word) and window == 20 else None


def added_spans(t, base):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t):
        window, bits = bits_of(m[0])
        if bits is None or any(a.search(m[0]) for a in ALLOWED):
            continue
        limit = math.floor((math.log2(window) - bits) * window * 1_000_000 + 1e-6)
        merged = []
        for i in range(len(m[0]) - window + 1):
            counts = collections.Counter(m[0][i:i + window]).values()
            if sum(round(c * math.log2(c) * 1_000_000) for c in counts) > limit:
                continue
            if merged and merged[-1][1] >= i:
                merged[-1][1] = i + window
            else:
                merged.append([i, i + window])
        for a, b in merged:
            a, b = a + m.start(), b + m.start()
            if not any(s < b and a < e for s, _, e in base):
                out.append((a, 3, b))
    return out


def names(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = find_secrets(df).select("doc_id", spelled("base").alias("b"),
                                   spelled("added").alias("a")).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r for r in rows}


def key(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_spans_against_a_loop(spark):
    rng = random.Random(11)
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    texts = [None, "", " ", "x" * 5000, key(rng, mixed, 3000), "é😀 " + key(rng, mixed, 30),
             "token=" + "a" * 7, "API_KEY : 'abcd.efgh'", "AKIA" + "A" * 11, "AKIA" + "B" * 12]
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([8, 15, 16, 18, 19, 20, 24, 32, 40])
            parts.append(rng.choice([
                lambda: key(rng, mixed, n), lambda: key(rng, string.ascii_letters, n),
                lambda: key(rng, string.ascii_lowercase, n), lambda: key(rng, hexes, n),
                lambda: key(rng, string.digits, n), lambda: "secret = " + key(rng, mixed, n),
                lambda: "AKIA" + key(rng, string.ascii_uppercase + string.digits, n),
                lambda: "words that are here, " * 2, lambda: "/usr/lib/python3/dist-packages",
                lambda: "example" + key(rng, mixed, n), lambda: key(rng, mixed + "+/_=-", n)])())
        texts.append(rng.choice([" ", ", ", "\n", "=", "é"]).join(parts))
    got = run(spark, texts)
    for n, t in enumerate(texts):
        base = base_spans(t or "")
        assert got[n].b == names(base), t
        assert got[n].a == names(added_spans(t or "", base)), t


def test_found_keys_and_false_alarms(spark):
    rng = random.Random(3)
    letters, mixed = string.ascii_letters, string.ascii_letters + string.digits
    for alphabet, n, least in ((mixed, 32, .98), (mixed, 24, .95), (mixed, 18, .9),
                               (letters, 32, .9), (string.ascii_lowercase, 40, .85)):
        got = run(spark, [f"the key {key(rng, alphabet, n)} is here" for _ in range(200)])
        assert sum(bool(r.a) for r in got.values()) >= 200 * least, (len(alphabet), n)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert find_secrets(docs).where("size(added) > 0").count() <= 1
    assert secrets.LONG == 20
