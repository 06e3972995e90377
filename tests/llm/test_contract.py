"""Each query against a brute-force version of its fixed columns, over whole tables and the edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from conftest import DATA, edge_rows

from seqmine.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = [(i, t) for i, t, *_ in edge_rows()]


def remainder(i, k):
    return zlib.crc32(b"" if i is None else str(i).encode()) % k


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def said(rows, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in rows)


@pytest.fixture(params=["whole", "edges"])
def case(request, edges, texts):
    return (edges, EDGE) if request.param == "edges" else (DATA, texts)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_columns(spark, edges, empty, name):
    out = QUERIES[name](spark, empty)
    assert out.count() == 0
    full = QUERIES[name](spark, edges)
    assert full.dtypes == out.dtypes
    if name != "op1_packing":
        assert sorted(str(r["doc_id"]) for r in full.select("doc_id").collect()) == sorted(str(i) for i, _ in EDGE)


def test_packing(spark, case):
    path, docs = case
    from tokenizers import Tokenizer

    rows = QUERIES["op1_packing"](spark, path).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in docs]
    # each id in exactly one piece: what a document's pieces say together, for each document with its repeats
    whole = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for i, ids in want:
        whole[i, len(ids)] += 1
        mine = {(r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i, len(ids)]}
        for start, length, crc in mine:
            if whole[i, len(ids)] == 1 and [x for x, _ in want].count(i) == 1:
                raw = b"".join(x.to_bytes(4, "little") for x in ids[start : start + length])
                assert zlib.crc32(raw) == crc
    for key, pieces in by_doc.items():
        cover = Counter(p for r in pieces for p in range(r["start"], r["start"] + r["length"]))
        assert cover == Counter({p: whole[key] for p in range(key[1])})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    used, cost = 0, 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        used += at
        cost += at if at & (at - 1) == 0 else 2048
    assert cost <= 1.02 * used


def test_secrets(spark, case):
    path, docs = case
    kinds = {
        "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
        "hex": (re.compile("[0-9a-f]+"), 0, 16),
    }
    want = []
    for i, t in docs:
        spans = [(m.start(), list(kinds).index(k), m.end(), k) for k, (p, g, n) in kinds.items() for m in p.finditer(t or "") if len(m[g]) >= n]
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        want.append((i, *(sum(s[3] == k for s in spans) for k in kinds), hashlib.sha256(text.encode()).hexdigest()))
    rows = QUERIES["op2_secrets"](spark, path).collect()
    assert said(rows, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(map(repr, want))
    for r in rows:
        found = [s.split(":") for s in r["spans"].split(",") if s]
        base = ",".join(":".join(s) for s in found if s[0] in kinds)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


def language_model(docs):
    """Counts in dictionaries and EM over every deleted bigram, without cells."""
    tokens = {n: [*WORD.findall(lower(t)), ""] for n, (_, t) in enumerate(docs)}
    fold = {n: remainder(i, 10) for n, (i, _) in enumerate(docs)}

    def counts(of):
        one, two = Counter(), Counter()
        for n in of:
            one.update(tokens[n])
            two.update(zip(["", *tokens[n]], tokens[n], strict=False))
        return one, two

    one, two = counts(n for n in fold if fold[n])
    less, less2 = counts(n for n in fold if fold[n] > 1)
    v, total, total_less = len(one), sum(one.values()), sum(less.values())
    events = defaultdict(Counter)
    for n in fold:
        if fold[n] == 1:
            for a, b in zip(["", *tokens[n]], tokens[n], strict=False):
                p = (less2[a, b] / less[a] if less[a] else 0.0, less[b] / max(1, total_less), 1 / (v + 1))
                events[math.frexp(less[a])[1]][p] += 1
    weights = {}
    for bucket, seen in events.items():
        even = (0, 0.5, 0.5) if not bucket else (1 / 3,) * 3
        w = even
        for _ in range(200):
            new = list(even)
            for p, k in seen.items():
                mix = sum(x * y for x, y in zip(w, p, strict=True))
                new = [u + k * x * y / mix for u, x, y in zip(new, w, p, strict=True)]
            w = tuple(x / (sum(seen.values()) + 1) for x in new)
        weights[bucket] = w
    for b in range(64):
        weights.setdefault(b, weights.get(b - 1, (1 / 3,) * 3) if b > 1 else ((0, 0.5, 0.5) if not b else (1 / 3,) * 3))
    for n, (i, _) in enumerate(docs):
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (v + 1))) for w in tokens[n])
        score = 0.0
        for a, b in zip(["", *tokens[n]], tokens[n], strict=False):
            w = weights[math.frexp(one[a])[1]]
            score += math.log10(w[0] * two[a, b] / max(1, one[a]) + w[1] * one[b] / total + w[2] / (v + 1))
        yield i, not fold[n], len(tokens[n]), sum(one[w] > 0 for w in tokens[n]), total, base, score


def test_interpolation(spark, case):
    path, docs = case
    rows = QUERIES["op3_interpolation"](spark, path).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got, want = sorted((tuple(r) for r in rows), key=key), sorted(language_model(docs), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=5e-3), (a, b)


def test_quality_counts(spark, case):
    path, docs = case
    want = []
    for i, t in docs:
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        want.append((i, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed))
    rows = QUERIES["op4_quality"](spark, path).collect()
    assert said(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(map(repr, want))
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_fingerprint_edits(spark, case):
    path, docs = case
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""), reverse=True)
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    rows = QUERIES["op5_fingerprints"](spark, path).collect()
    assert said(rows, "doc_id", "n_chars", "edited_sha256") == sorted(map(repr, want))
    if path == DATA:
        fp = {r["doc_id"]: r["fingerprint"] for r in rows}
        by_text = defaultdict(set)
        for i, t in docs:
            by_text[t or ""].add(fp[i])
        assert all(len(x) == 1 for x in by_text.values())
        # the likeness is close to the generalised Jaccard similarity of lower-case words
        text = dict(docs)
        after = dict(zip((i for i, _ in ordered), ordered[1:] + ordered[:1], strict=True))
        errors = []
        for r in rows:
            a, b = (Counter(WORD.findall((x or "").lower())) for x in (text[r["doc_id"]], after[r["doc_id"]][1]))
            exact = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
            errors.append(r["near_next"] - exact)
            assert 0 <= r["near_edited"] <= 1
        assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.25


def test_language(spark, case):
    path, docs = case
    text = defaultdict(list)
    for i, t in docs:
        text[i].append(t)
    for r in QUERIES["op6_langid"](spark, path).collect():
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        lettered = [bool(t) and any(c.isalpha() for c in t) for t in text[r["doc_id"]]]
        assert (r["lang_pred"] != "und") in lettered


def simhash(t):
    words = WORD.findall(lower(t))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, case):
    path, docs = case
    docs = [(i, simhash(t)) for i, t in docs]
    nodes = sorted({f for _, f in docs})
    root = {f: f for f in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                old = root[b]
                root = {f: root[a] if r == old else r for f, r in root.items()}
    least = {}
    for i, f in docs:
        least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
    want = [(i, f"{f:016x}", least[root[f]]) for i, f in docs]
    assert said(QUERIES["op7_simhash"](spark, path).collect(), "doc_id", "fingerprint", "component_id") == sorted(map(repr, want))


def test_bpe(spark, case):
    path, docs = case
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in docs:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert said(QUERIES["op8_bpe"](spark, path).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(repr, want))


def test_toxicity_columns(spark, case):
    path, _ = case
    for r in QUERIES["op9_toxicity"](spark, path).collect():
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_sql(spark, case):
    import duckdb

    from seqmine.llm.queries import ORACLE_SQL

    assert "op4_quality" in ORACLE_SQL
    path, _ = case
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{'' if path == DATA else '/*.parquet'}'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, path)
        columns, want = sorted(df.columns), con.sql(sql)
        assert columns == sorted(want.columns)
        assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(r) for r in want.select(*columns).fetchall())
