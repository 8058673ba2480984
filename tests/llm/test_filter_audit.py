"""The audit of filter orders against a plain walk over documents and orders."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

from sigwatch.llm import filter_audit

SF = "/root/testdata/sf0.001"


def failed(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return "".join(letter for letter, fails in (
        ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", re.search(r"[#$%&*|]", text))) if fails)


def plain(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[at] == 1} for at in (1, 2))
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    counts, shapley = defaultdict(Counter), Counter()
    for key, text, source in docs:
        text, part = text or "", source or ""
        fails = failed(text) + ("E" if key is not None and key > least[text] else "")
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                row = counts[part, order, step]
                row["unique_fails"] += fails == letter
                if letter in fails:
                    row["redundant" if gone else "removed"] += 1
                    if not gone:
                        row["good_lost"] += key in good
                        row["toxic_lost"] += key in toxic
                        shapley[part, letter] += 1
                    gone = True
                row["kept"] += not gone
    return {(*key, *(row[m] for m in filter_audit.MEASURES), shapley[key[0], key[1][key[2] - 1]])
            for key, row in counts.items()}


def found(docs, labels):
    frame = filter_audit.audit(docs, labels)
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_equals_a_plain_walk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.limit(60).unionByName(docs.limit(5).withColumn("doc_id", docs.doc_id + 1000))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert found(docs, labels) == plain(rows, [tuple(r) for r in labels.collect()])


def test_odd_rows(spark):
    long = " ".join(f"Word{i}" for i in range(3000))
    rows = [(3, "same", "s"), (1, "same", "t"), (1, "same", "t"), (1, "same", "s"), (None, "same", "s"), (2, "same", None),
            (4, None, ""), (5, "", "s"), (6, long, "s"), (7, " \t#Aéé \x0b", "s"), (8, "ABC " * 80, "t"),
            (9, " x " * 60, "t"), (None, None, None)]
    marks = [(1, 1, 0), (1, 0, None), (2, None, 1), (None, 1, 1), (6, 0, 1), (8, 1, 1)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, quality int, part int")
    labels = spark.createDataFrame([(*r, "") for r in marks], "doc_id long, quality int, toxic int, text string")
    assert found(docs.repartition(4), labels) == plain(rows, marks)


def test_ranks_follow_lexicographic_order():
    orders = list(itertools.permutations(range(5)))
    assert [filter_audit.rank(o) for o in orders] == list(range(120))
    for _, first, behind, begin in filter_audit.intervals():
        assert all((o[:len(begin)] == begin) == (first <= r < behind) for r, o in enumerate(orders))


@pytest.mark.parametrize("schema", ["doc_id long, text string, source string"])
def test_empty_table(spark, schema):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], schema), labels).count() == 0
