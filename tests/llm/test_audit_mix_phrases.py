"""Source divergence, mixing and phrase collocations against plain Python and odd inputs."""

import collections
import fractions
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from buildlens.llm import queries
from buildlens.llm.collocations import Summary, Words, _chunks, collocations, pack, unpack
from buildlens.llm.divergence import document_terms, source_divergence
from buildlens.llm.mixing import mix_sources, word_count

SF = "/root/testdata/sf0.001"
#: Columns beside those that are read have the names of results.
SCHEMA = "doc_id bigint, text string, lang string, source string, item string, rank string, size string, key string, phrase string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "k", "p") for r in rows], SCHEMA)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def some_docs():
    rng = random.Random(5)
    words = ["the", "cat", "Sat", "ON", "mat", "naïve", "x1y", "straße", "日本", "a-b", "of", "New", "York"]
    rows = []
    for i in range(120):
        n = rng.choice([0, 1, 3, 20, 60])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(n))
        rows.append((i % 97, rng.choice([text, text, None, "", text * 3]), rng.choice(["en", "de", None, "", "und"]), rng.choice(["a", "b", "ç", None, ""])))
    return rows + [rows[3]] * 4 + [(None, "cat mat cat mat", "en", "a"), (None, None, None, None)]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_mixing", "op13_collocations"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.select(*columns), *columns) == sorted(want.fetchall())


# ------------------------------------------------------------------ divergence


def brute_divergence(rows, least, most):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(lang or "", source or "", collections.Counter(term.findall(lower(text)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        inside = collections.Counter(t for d in own for t in d[2])
        kept = {t for t, n in inside.items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = share(sum((d[2] for d in own), collections.Counter()))
        counts = {s: sum((d[2] for d in own if d[1] == s), collections.Counter()) for s in {d[1] for d in own}}
        p = {s: share(c) for s, c in counts.items()}
        order = lambda f: sorted(f, key=lambda x: (-x[1], x[0].encode()))
        for s in counts:
            pairs = order([(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s])
            terms = order([(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]])[:most]
            out += [(lang, s, part, item, v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (item, v) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 5, 1000])
def test_divergence_equals_brute_force(spark, some_docs, least):
    got = source_divergence(table(spark, some_docs), least, 4)
    assert rows_of(got, "lang", "source", "part", "item", "value", "rank") == brute_divergence(some_docs, least, 4)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_terms_of_a_document():
    text = "Aé-Zz a_b\x00C~日本 ZZ"
    want = collections.Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text)))
    assert {k.decode(): n for k, n in document_terms(text.encode()).items()} == want


def test_divergence_hands_on_in_parts(spark, some_docs, monkeypatch):
    monkeypatch.setattr("buildlens.llm.divergence.ENTRIES", 3)
    monkeypatch.setattr("buildlens.llm.divergence.CELLS", 5)
    got = source_divergence(table(spark, some_docs), 2, 50)
    assert rows_of(got, "lang", "source", "part", "item", "value", "rank") == brute_divergence(some_docs, 2, 50)


# ---------------------------------------------------------------------- mixing


def brute_targets(rows):
    size = collections.Counter()
    for _, text, _, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = fractions.Fraction(3 * sum(size.values()), 2), set(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: per * weight[s] for s in open_}
            break
        for s in full:
            target[s] = fractions.Fraction(2 * size[s])
            left -= target[s]
        open_ -= full
    return size, target


def check_mix(rows, got):
    size, target = brute_targets(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, words(t)) for i, t, _, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target].append(r)
    assert sorted(by) == sorted({(size[s], float(target[s])) for s in size})
    assert sum(target.values()) * 2 == 3 * sum(size.values())
    for (_, want), own in by.items():
        n = sum(1 for s in size if (size[s], float(target[s])) == (own[0].source_size, want))
        assert abs(sum(r.taken for r in own) - n * want) <= n * max(r.size for r in own) / 2 + 1e-6


def test_mix_targets_and_budgets(spark, some_docs):
    got = mix_sources(table(spark, some_docs)).collect()
    check_mix(some_docs, got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(table(spark, some_docs[::-1]).repartition(7)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000}, {"a": 0, "b": 0}, {"a": 50, "b": 7, "c": 3000, "d": 0, "e": 11, None: 5}])
def test_mix_with_caps(spark, sizes):
    rng = random.Random(1)
    rows = []
    for s, n in sizes.items():
        rows.append((len(rows), None, "en", s))
        while n > 0:
            k = min(n, rng.randrange(1, 9))
            rows.append((len(rows), "w " * k, "en", s))
            n -= k
    check_mix(rows, mix_sources(table(spark, rows)).collect())


def test_mix_takes_some_of_equal_rows(spark):
    rows = [(1, "four words are here", "en", "a")] * 30 + [(2, "b " * 60, "en", "b")]
    got = mix_sources(table(spark, rows)).collect()
    check_mix(rows, got)
    assert len({r.taken for r in got if r.doc_id == 1}) == 2
    assert mix_sources(table(spark, rows)).count() == 31


def test_word_count(spark):
    texts = ["", None, " a\x0bb\x0cc\td\ne\rf ", "\x1fx\x85y é 日本 ", "😀 👍🏽"]
    got = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("doc_id", word_count().alias("n"))
    assert [n for _, n in rows_of(got, "doc_id", "n")] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# ---------------------------------------------------------------- collocations


def brute_collocations(rows, least, most):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            own = "und" if lang is None else lang
            n[own] += len(w)
            for k in range(1, 5):
                f[own].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
        keep = []
        for p, a in found.items():
            if any(len(y) > len(p) and inside(p, y) and 100 * b >= 80 * a for y, b in found.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            keep.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(keep)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "most"), [(2, 5), (6, 2000), (30, 2000), (10**6, 5)])
def test_collocations_equal_brute_force(spark, some_docs, least, most):
    got = collocations(table(spark, some_docs), least, most)
    assert rows_of(got, *got.columns) == brute_collocations(some_docs, least, most)
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_collocations_with_small_parts(spark, some_docs, monkeypatch):
    for name, value in (("GATHERED", 50), ("CHUNK", 64), ("ENTRIES", 7)):
        monkeypatch.setattr(f"buildlens.llm.collocations.{name}", value)
    got = collocations(table(spark, some_docs), 6, 100)
    assert rows_of(got, *got.columns) == brute_collocations(some_docs, 6, 100)


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(3)
    for least, items in ((5, 4000), (30, 50_000)):
        seen = np.concatenate([rng.integers(0, items, 60_000), rng.zipf(1.3, 30_000) % items]).astype(np.uint64)
        rng.shuffle(seen)
        s = Summary(len(seen) // least + 1)
        for part in np.array_split(seen, 37):
            s.add(*np.unique(part, return_counts=True))
            s.settle()
        values, counts = np.unique(seen, return_counts=True)
        assert s.lost < least and len(s.h) <= s.capacity
        assert set(values[counts >= least].tolist()) <= set(s.candidates(least).tolist())
    # a summary that has to let counters go
    s = Summary(100)
    for part in np.array_split(seen, 37):
        s.add(*np.unique(part, return_counts=True))
        s.settle()
    assert 0 < s.lost <= len(seen) / 101
    assert set(values[counts > s.lost].tolist()) <= set(s.h.tolist())


def test_runs_and_chunks():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    n = np.arange(len(h)) % 30
    assert all((a == b).all() for a, b in zip((h, n), unpack(pack(h, n)), strict=True))
    text = b"a b\nc " * 700_000 + b"z" * (3 << 20) + b"\nend"
    assert b"".join(_chunks(text)) == text
    w = Words(b"a bc  a\nbc a", np.uint64(7))
    grams = {w.text[w.start[i] : w.end[i + k - 1]] for k, first, _ in w.grams() for i in first}
    assert grams == {b"a", b"bc", b"a bc", b"bc a", b"a bc a"}
    by_text = collections.defaultdict(set)
    for k, first, hashes in w.grams():
        for i, x in zip(first, hashes, strict=True):
            by_text[w.text[w.start[i] : w.end[i + k - 1]]].add(int(x))
    assert all(len(x) == 1 for x in by_text.values()) and len(set(itertools.chain(*by_text.values()))) == 5


@pytest.mark.parametrize("operator", [source_divergence, mix_sources, collocations])
def test_empty_table(spark, operator):
    assert operator(table(spark, []).limit(0)).collect() == []
