"""Decontamination, runs and spelling variants against brute-force versions, through their queries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import contamination, fm_index, periodic, queries, spelling

CLASHING = ("text", "id", "n", "word", "spans", "runs", "near", "h", "w", "_row")


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _table(spark, rows, folder, name, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Decontamination


def _leaks(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            phrases[tuple(w[k : k + width])].add("" if item is None else str(item))
    out = []
    for id_, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                if p := phrases.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= p
        out.append((id_, len(w), len(hit), len(found), _sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def _leaky(seed=5):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)] + ["Éa", "ñ", "zz"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(30)]
    items += [(None, "lonely words here"), (7, "one id twice"), (3, None), (98, "y" * 200 + " tail"), (99, items[5][1])]
    docs = []
    for i in range(150):
        text = rng.choices(pool, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items)[1] or "").split()
            at, low = rng.randrange(len(text) + 1), rng.randrange(len(item) + 1)
            text[at:at] = item if rng.random() < 0.5 else item[low : low + 12]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 7 else " ".join(text)))
    docs += [(None, None), (None, "w1 w2"), (1, ""), (1, "ONE ID TWICE"), (2, "one id twice " * 30), (3, "x " * 5000 + items[6][1] + " y" * 5000), (4, "y" * 200 + "-tail")]
    return docs, items


def test_decontamination_matches_brute_force(spark, tmp_path):
    docs, items = _leaky()
    _table(spark, [(*d, 1) for d in docs], tmp_path, "documents", "doc_id long, text string, spans int")
    _table(spark, [(*i, 1) for i in items], tmp_path, "benchmark", "item_id long, text string, n_words int")
    got = _rows(queries.op11_decontamination(spark, str(tmp_path)))
    assert got == _leaks(docs, items)
    assert sum(r[5] for r in got) > 50


def test_blocks_of_phrases_and_cut_shards_give_the_same(spark):
    docs, items = _leaky(6)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda df: sorted([(r[0], r[1], tuple(map(tuple, r[2])), tuple(r[3])) for r in df.collect()], key=repr)
    whole = plain(contamination.find(d, i))
    assert plain(contamination.find(d, i, block_bytes=2_000)) == whole
    assert plain(contamination.find(d, i, shard=64)) == whole
    for name in ("id", "n_words", "items"):
        assert contamination.find(d.withColumnRenamed("doc_id", name).limit(3), i, id_col=name).count() == 3


def test_spans_are_cut_from_texts(spark):
    d = spark.createDataFrame([(1, "Keep this. A b c! And – this"), (2, "a b c a B c"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = contamination.find(d, i, width=3).join(d, "doc_id")
    got = {r[0]: r[1] for r in found.select("doc_id", contamination.cut(found["text"], found["spans"])).collect()}
    assert got == {1: "Keep this. ! And – this", 2: "", 3: None}


def test_decontamination_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.find(d.limit(0), i).count() == 0
    assert contamination.find(d, i.limit(0)).collect()[0]["spans"] == []


@pytest.mark.parametrize("symbols", [1, 2, 5, 300])
def test_index_finds_every_place(symbols):
    rng = np.random.default_rng(symbols)
    for n in (0, 1, 2, 63, 64, 65, 400):
        text = rng.integers(0, symbols, n)
        text = np.tile(text[: max(1, n // 7)], 8)[:n] if n % 2 else text
        index = fm_index.Index(text, symbols)
        for size in (1, 2, 5):
            phrases = rng.integers(0, symbols, (30, size))
            for p, low, high in zip(phrases, *index.search(phrases), strict=True):
                assert sorted(index.locate(np.arange(low, high)).tolist()) == [k for k in range(n - size + 1) if (text[k : k + size] == p).all()]


# Runs


def _runs(a, least=6, exponent=4):
    out = []
    for q in range(1, len(a) // exponent + 1):
        i = 0
        while i + q < len(a):
            start = i
            while i + q < len(a) and a[i] == a[i + q]:
                i += 1
            size = i - start + q
            if size >= max(least, exponent * q) and not any(all(a[k] == a[k + p] for k in range(start, start + size - p)) for p in range(1, q)):
                out.append((start, size, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic(docs):
    out = []
    for id_, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if id_ is not None and (h := zlib.crc32(str(id_).encode())) % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = _runs(w)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        s, size, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        out.append((id_, len(found), s, size, q, 1000 * size // q if found else None, _sha(lines), _sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def test_runs_match_brute_force(spark, tmp_path):
    rng = random.Random(2)
    docs = []
    for i in range(400):
        w = rng.choices("abcdefgh"[: rng.randrange(1, 9)], k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            w += rng.choices("abcd", k=rng.randrange(1, 5)) * rng.randrange(1, 9)
        docs.append((i, rng.choice([" ", "\n", " \t\x0b"]).join(w)))
    docs += [(None, None), (None, "a a a a a a"), (1, ""), (10, None), (11, " x " * 3000), (12, "x y " * 900 + "é ü " * 400), (11, " x " * 3000)]
    _table(spark, [(*d, 1, "x") for d in docs], tmp_path, "documents", "doc_id long, text string, w int, runs string")
    got = _rows(queries.op12_periodic_runs(spark, str(tmp_path)))
    assert got == _periodic(docs)
    assert sum(r[1] > 0 for r in got) > 100


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (6, 2), (1, 3)])
def test_runs_of_all_kinds(least, exponent):
    rng = np.random.default_rng(least * exponent)
    for _ in range(1200):
        a = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70))
        if len(a) > 4:
            low = int(rng.integers(0, len(a)))
            period = 1 + int(rng.integers(0, max(1, (len(a) - low) // 3)))
            for i in range(low, int(rng.integers(low, len(a) + 1))):
                a[i] = a[low + (i - low) % period]
        assert periodic.runs(a, least, exponent) == _runs(a.tolist(), least, exponent)


def test_hashes_that_collide_change_no_run(monkeypatch):
    monkeypatch.setattr(periodic._Text, "_equal", lambda self, i, j, size: True)
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.tile(rng.integers(0, 3, rng.integers(1, 30)), 5)
        a[rng.integers(0, len(a), 2)] = 1
        assert periodic.runs(a, 2, 2) == _runs(a.tolist(), 2, 2)


def test_runs_of_one_word_and_of_no_rows(spark):
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find(empty).collect() == []
    got = periodic.find(spark.createDataFrame([("k", "a b a b a b a b c")], "runs string, text string"), id_col="runs").collect()
    assert [got[0][0], got[0]["n_words"], got[0]["collapsed"]] == ["k", 9, "a b c"]


# Spelling


def _spelling(docs, ratio=5):
    counts = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def edits(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))

    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def test_variants_match_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ÀÉÎÕÜÿ", "x×y÷zzz"]
    words = []
    for w in base:
        many = rng.choice([5, 6, 40, 300, 2000])
        words += [w] * many
        v = w
        for _ in range(3):  # chains of variants, each rarer
            many, k = many // 6 + 1, rng.randrange(len(v))
            v = rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice("abcé") + v[k:], v[:k] + rng.choice("abcé") + v[k + 1 :]])
            words += [v] * many
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", "1", "—", "日本", "\n"]).join(x.upper() if i % 3 == 0 and x.isascii() else x for x in words[k : k + 60])) for i, k in enumerate(range(0, len(words), 60))]
    docs += [(None, None), (None, "colour " * 9), (1, ""), (2, "q" * 3000), *[(2, "q" * 3000)] * 9, (5, "colours " * 50)]
    _table(spark, [(*d, "x") for d in docs], tmp_path, "documents", "doc_id long, text string, word string")
    got = _rows(queries.op13_spelling_variants(spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root"))
    assert got == _spelling(docs)
    assert sum(r[3] is not None and r[3] != r[5] for r in got) > 5  # forms of forms


def test_neighbourhood_is_whole_and_distinct():
    alphabet = sorted(map(ord, "abcé"))
    for word in ("aabbca", "éééééé", "abcabc"):
        hashes = spelling.Hashes(alphabet)
        of = lambda w: int(hashes.words(np.frombuffer(w.encode("latin-1"), np.uint8).reshape(1, -1).astype(np.int64))[0])
        got = [int(x) for _, h, mask in hashes.neighbours(np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1).astype(np.int64)) for x in h[mask]]
        letters = "abcé"
        want = {word[:k] + word[k + 1 :] for k in range(6)} | {word[:k] + c + word[k + 1 :] for k in range(6) for c in letters if c != word[k]} | {word[:k] + c + word[k:] for k in range(7) for c in letters}
        assert sorted(got) == sorted(map(of, want))


def test_variants_of_no_rows(spark):
    assert spelling.group(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
