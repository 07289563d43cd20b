"""The filter audit against brute force over documents, orders and steps."""

import os
import re
from itertools import permutations

import pytest

from molweave.llm import audit
from molweave.llm.queries import table
from molweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def by_hand(documents, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in documents]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failures = []
    for (doc_id, text, _), ws in zip(documents, words):
        text = text or ""
        smaller = [1 for other, t, _ in documents if (t or "") == text and other is not None and doc_id is not None and other < doc_id]
        failed = [
            len(ws) < 50,
            100 * len(set(ws)) < 65 * len(ws),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)),
            bool(smaller),
        ]
        failures.append({name for name, f in zip("ABCDE", failed) if f})
    rows = {}
    for part in {s or "" for _, _, s in documents}:
        here = [(d[0], f) for d, f in zip(documents, failures) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, name in enumerate(order, 1):
                removed = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[name] += len(removed)
                rows[part, order, step] = [
                    len(left),
                    len(removed),
                    sum(name in f for _, f in here) - len(removed),
                    sum(f == {name} for _, f in here),
                    sum(i in good for i, _ in removed),
                    sum(i in toxic for i, _ in removed),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def as_rows(df):
    got = {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in df.collect()}
    assert len(got) == df.count()
    return got


def test_edges(spark, edge_documents, edge_labels, no_documents):
    more = edge_documents.unionByName(edge_documents.filter("doc_id = 1").selectExpr("CAST(0 AS LONG) AS doc_id", "* EXCEPT (doc_id)"))
    documents = [(r.doc_id, r.text, r.source) for r in more.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in edge_labels.collect()]
    got = as_rows(audit.audit(more, edge_labels))
    assert got == by_hand(documents, labels)
    assert {k[0] for k in got} == {"", "a", "b", "c"} and len(got) == 4 * audit.STEPS
    assert audit.audit(no_documents, edge_labels).isEmpty()
    assert as_rows(audit.audit(edge_documents, edge_labels.limit(0)))["a", "ABCDE", 1][4:6] == [0, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_whole_table(spark):
    documents = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, SF, "labels").collect()]
    assert as_rows(QUERIES["op13_filter_audit"](spark, SF)) == by_hand(documents, labels)


def test_fields_do_not_run_over():
    wide = audit.wide_counters()
    assert audit.unpack(0, 2 * audit.STEPS).sum() == 0
    many = (1 << (audit.WIDTH - 1)) - 1
    fields = audit.unpack(wide[31] * many + wide[1] * 0, 2 * audit.STEPS)
    assert set(fields.tolist()) == {0, many} and (fields == many).sum() == audit.STEPS
    assert all(audit.unpack(w, 2 * audit.STEPS).max(initial=0) <= 1 for w in wide)


def test_rows_with_copies_stay_few(spark):
    """A third of all rows is one text: its groups are summed before they meet."""
    df = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', concat('t', id)) AS text", "CAST(id % 2 AS STRING) AS source")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = audit.mask_counts(df, labels).collect()
    assert sum(r.n for r in rows) == 6000
    assert sum(r.n for r in rows if r["mask"] >> 4) == 1999
