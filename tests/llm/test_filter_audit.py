import itertools
import re

import pytest
from pyspark.sql import functions as F

from tapewire.llm import filter_audit
from tapewire.llm.filter_audit import METRICS, audit, masks
from tests.llm.frames import no_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int, mask int, part string, n long"


def brute(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic).  All orders, one document at a time."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = ""
        bad += "A" if len(w) < 100 else ""
        bad += "B" if 100 * len(set(w)) < 80 * len(w) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else ""
        bad += "D" if re.search("[#$%&*|]", t) else ""
        bad += "E" if i is not None and first[t] < i else ""
        fails.append((i, part or "", bad))
    out, shapley = {}, {}
    for part in {p for _, p, _ in fails}:
        rows = [(i, bad) for i, p, bad in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                every = [r for r in rows if f in r[1]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), len(every) - len(gone), sum(b == f for _, b in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(frame):
    return {(r.part, r.filter_order, r.step): (*[r[m] for m in METRICS], r.shapley) for r in frame.collect()}


def labelled(spark):
    rows = [(1, 1, 0), (1, 0, 1), (5, 1, 1), (6, None, 1), (None, 1, 1), (12, 1, None), (999, 1, 1), (8, 0, 0)]
    return spark.createDataFrame([(*r, 0, "x", 5) for r in rows], LABELS)


def test_equals_every_order_one_by_one(spark):
    docs, labels = odd_docs(spark).withColumnsRenamed({"key": "mask", "digest": "own", "row": "first"}), labelled(spark)
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r[:3]) for r in labels.collect()])
    assert got(audit(docs, labels)) == want


def test_parts_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_A_RUN", 1)
    docs = spark.createDataFrame([(i, f"same # {i % 3}", f"p{i % 4}") for i in range(20)], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(0, 20, 3)], "doc_id int, quality int, toxic int")
    assert got(audit(docs, labels)) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_empty_tables(spark):
    assert audit(no_docs(spark), labelled(spark)).count() == 0
    some = audit(odd_docs(spark), labelled(spark).where("doc_id > 5000"))
    assert some.where("good_lost > 0 OR toxic_lost > 0").count() == 0 and some.where("part = ''").count() == 600


def test_a_text_of_a_third_of_the_table(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counted = {r["mask"]: r.n for r in masks(docs, labels).collect()}
    assert counted == {1: 4001, 17: 1999}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_parts_and_ids_of_other_types(spark, kind):
    docs = spark.createDataFrame([(1, "a", 7), (2, "a", 7), (3, "b", None)], "doc_id int, text string, lang int").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id int, quality int, toxic int")
    rows = got(audit(docs, labels))
    assert rows["7", "EABCD", 1][:2] == (1, 1) and rows["7", "EABCD", 1][4] == 1 and rows["", "ABCDE", 1][1] == 1
