"""Quality rules and exact dedup against plain Python, and against SQL."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, quality_rules
from tessera.llm.queries import ORACLES, QUERIES

WORD, GAP = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]+")


def good(k: int) -> str:
    return " ".join(f"The{k} word{k}-{j} of{j}" for j in range(6)) + ", and rests."


#: Clean prose to keep, and junk of several kinds to reject.
CLEAN = "\n".join(map(good, range(8)))
JUNK = ["\n".join(["Home | About | Contact | Login |"] * 20), " ".join(f"word{k}***" for k in range(80)), " ".join(f"STOP{k}!!" for k in range(80)), "same " * 80, "short text."]


def figures(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {p + k for starts in places.values() if len(starts) > 1 for p in starts for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    texts = [*odd_texts, CLEAN, *JUNK, CLEAN + "\n" + good(3), "a b c a b c a b", CLEAN + "\nReleased under the MIT License."]
    return spark.createDataFrame([(i, t, "kept", 3) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int")


def test_figures_and_base(docs):
    got = quality_rules.clean_lines(docs).collect()
    want = {r.doc_id: figures(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    assert all(r.base_failed == (want[r.doc_id][0] < 50 or 100 * want[r.doc_id][4] > 50 * want[r.doc_id][0]) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_clean_documents_stay_and_junk_goes(docs):
    kept, whole = {r.doc_id: r.text for r in quality_rules.filter_documents(docs).collect()}, {r.doc_id: r.text for r in docs.collect()}
    texts = {whole[i] for i in kept}
    assert CLEAN in texts and CLEAN + "\nReleased under the MIT License." in texts and not texts & set(JUNK)
    assert set(kept) == {r.doc_id for r in quality_rules.clean_lines(docs).where("kept").collect()}
    assert all(t == whole[i] or t == CLEAN and whole[i].startswith(CLEAN) for i, t in kept.items())


def test_removed_lines(docs):
    rows = {r.doc_id: r for r in quality_rules.clean_lines(docs, with_text=True).collect()}
    licensed = next(r.doc_id for r in docs.collect() if (r.text or "").endswith("MIT License."))
    assert rows[licensed].clean_text == CLEAN and rows[licensed].n_boilerplate == 1
    assert max(r.n_navigation for r in rows.values()) == 20


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=40))
def test_repeats_of_few_words(spark, words):
    row = quality_rules.clean_lines(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")).first()
    assert row.n_repeat_words == figures(" ".join(words))[4]


def test_dedup_by_brute_force(spark, odd_texts):
    texts = [*odd_texts, "a b", "ab", " a\tb ", "a b", "ab  ", None]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    norm = {i: GAP.sub("", t or "") for i, t, _ in rows}
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm[i]].append((-len(t or ""), i))
    want = {(i, min(groups[norm[i]])[1], len(groups[norm[i]]), min(groups[norm[i]])[1] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, _, _ in rows}
    assert {tuple(r) for r in exact_dedup.dedup(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.keep_first(docs).collect()} == {w[1] for w in want}
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_texts_with_one_hash_stay_apart(spark, monkeypatch):
    """With a hash that collides always, bytes alone tell texts apart."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id int, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.dedup(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, None)], "doc_id int, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect())
    assert got == Counter({(None, None, 3, True): 1, (1, None, 3, False): 2, (None, None, 1, True): 1})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_native_plans(spark, sf_dir):
    for name in ("op1_quality_rules", "op9_exact_dedup"):
        assert "Python" not in (plan := QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()) and "Arrow" not in plan
