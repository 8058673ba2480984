"""Collocations against plain counting of every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigwatch.llm import collocations

SF = "/root/testdata/sf0.001"


def plain(rows, support=10, longest=3, top=2000, cover=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    found = set()
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        covered = Counter()
        for p, a in able.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i:i + size]] = max(covered[p[i:i + size]], a)
        rows = []
        for p, a in able.items():
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            if 100 * covered[p] < cover * a:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            found.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return found


def rows_of(frame):
    found = [tuple(r) for r in frame.collect()]
    assert len(set(found)) == len(found)
    return set(found)


@pytest.mark.parametrize("shards,support,most_bits,longest", [(4, 10, 1 << 27, 3), (3, 10, 64, 3), (9, 3, 1 << 12, 4), (1, 1, 1 << 20, 2)])
def test_phrases_equal_plain_counting(spark, shards, support, most_bits, longest):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    found = collocations.collocations(docs, shards=shards, support=support, most_bits=most_bits, longest=longest)
    expected = plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], support, longest)
    assert rows_of(found) == expected and expected


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    noise = [" ".join(rng.choice(["a", "Bé", "c\x00", "日本", "É", "x" * 300], 40)) for _ in range(20)]
    rows = [("en", "New  York\tcity. new york\nCITY"), (None, None), (None, ""), ("en", None), (None, " \t . "), ("und", "p q"),
            (None, "P Q"), ("", "to be or")] * 8 + [(lang, t) for t in noise for lang in ("en", "é", None)]
    rows += [("de", "ein langer text, " * 5000 + "ohne " * 3000)]
    docs = spark.createDataFrame([(l, t, 1, 2) for l, t in rows], "lang string, text string, f long, n long").repartition(3)
    assert rows_of(collocations.collocations(docs)) == plain(rows)
    assert rows_of(collocations.collocations(docs, top=3)) == plain(rows, top=3)


def test_sections_part_no_piece(monkeypatch):
    monkeypatch.setattr(collocations, "_BYTES", 10)
    for text in (b"", b"short", b"a b c, d e f g h i j k l m. n o p; q r s t", b"no break at all in here anywhere"):
        parts = list(collocations._sections(text))
        assert b"".join(parts) == text and all(collocations._BREAK.match(p[-1:]) for p in parts[:-1])


def test_large_counts_stay_exact(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    a, l, r = 999_999_937, 1_000_000_007, 3_000_000_019
    found = collocations.scored(frame([("x", "p q", 2, a * 1000)]), frame([("x", "p", 1, l * 1000), ("x", "q", 1, r * 1000)]))
    assert found.first().score == 10**6 * a * a // (l * r)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_few_texts_and_entries_are_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_KEPT", 100)
    monkeypatch.setattr(collocations, "_PORTION", 10)
    schema = collocations.pa.schema([("lang", "string"), ("phrase", "string"), ("size", "int32"), ("f", "int64")])
    count = collocations._count(lambda words: [(1, np.arange(len(words.starts)))], schema)
    text = " ".join(f"w{i % 700}" for i in range(1400)).encode()
    batch = collocations.pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text, b"w1"]})
    found = list(count(iter([batch])))
    assert max(b.num_rows for b in found) <= 110
    total = Counter()
    for b in found:
        for r in b.to_pylist():
            total[r["lang"], r["phrase"], r["size"]] += r["f"]
    assert total == {**{("en", f"w{i}", 1): 2 for i in range(700)}, ("de", "w1", 1): 1}

    sizes, name, kept = [], collocations._BATCHES, collocations.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(collocations, "stored", lambda *a: sizes.append(int(spark.conf.get(name))) or kept(*a))
    texts = spark.createDataFrame([("en", "a b c " * 12)], "lang string, text string")
    assert collocations.collocations(texts).count() > 0
    assert sizes == [1000] * 3 and spark.conf.get(name) == before
