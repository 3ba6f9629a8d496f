"""Filter interactions against a walk of every row through every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from opsloom.llm import filteraudit
from opsloom.llm.catalog import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def plain_failures(docs):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    shapley = defaultdict(int)
    for (i, _, part), fails in zip(docs, plain_failures(docs)):
        part = part or ""
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                if not gone and not fails[f]:
                    row[0] += 1
                elif not gone:
                    row[1] += 1
                    row[4] += i in good
                    row[5] += i in toxic
                    shapley[part, f] += 1
                elif fails[f]:
                    row[2] += 1
                row[3] += fails[f] and sum(fails.values()) == 1
                gone = gone or fails[f]
    return {(p, o, s): (*row, shapley[p, o[s - 1]]) for (p, o, s), row in out.items()}


def as_rows(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_table_against_a_walk(spark):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, FOLDER, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, FOLDER, "labels").collect()]
    assert as_rows(QUERIES["op11_filter_interactions"](spark, FOLDER)) == plain_audit(docs, labels)


def test_random_rows_with_copies_nulls_and_repeats(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "c#", "Dd", "\t", "é|"]) for _ in range(rng.choice([0, 3, 49, 50, 60]))) for _ in range(12)]
    texts += [None, "", " ".join(f"w{k}" for k in range(70)), " ".join(f"w{k % 40}" for k in range(61)), "AB" + "c" * 38, "ABC" + "d" * 37]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(150)]
    docs += docs[:10]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    # extra columns with names that the operator uses itself
    d = spark.createDataFrame([(*r, 7, "z", [1]) for r in docs], "doc_id bigint, text string, source string, mask int, part string, digest array<int>")
    m = spark.createDataFrame([(*r, "u") for r in labels], "doc_id bigint, quality int, toxic int, text string")
    assert as_rows(filteraudit.filter_interactions(d, m)) == plain_audit(docs, labels)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.node) for r in awkward.collect()]
    assert as_rows(filteraudit.filter_interactions(awkward, labels, part_col="node")) == plain_audit(docs, [(6, 1, 0), (7, 0, 1)])
    assert as_rows(filteraudit.filter_interactions(awkward, labels.limit(0), part_col="node")) == plain_audit(docs, [])
    assert filteraudit.filter_interactions(nothing, labels, part_col="node").count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_other_numbers_of_filters(n):
    rng = np.random.default_rng(n)
    tensor = rng.integers(0, 9, (3, *[2] * n))
    orders = filteraudit.Orders(n)
    found = orders.figures(tensor)
    for k, name in enumerate(orders.names):
        assert found["kept"][k * n + n - 1] == tensor[0][(0,) * n]
        assert found["removed"][k * n : k * n + n].sum() + tensor[0][(0,) * n] == tensor[0].sum(), name
