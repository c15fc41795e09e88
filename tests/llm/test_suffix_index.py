"""The suffix arrays that are kept between jobs, against a set of all strings so far."""

import random

import numpy as np

from veriplex.llm import suffix_index as X
from veriplex.llm.suffixes import suffix_order
from veriplex.llm.windows import covered

WINDOW = 50


def expected(batches):
    """(doc_id, n_removed, n_spans) of each batch's rows: earlier batches first, in a batch the smaller doc_id."""
    before, out = set(), []
    for rows in batches:
        first = {}
        for doc_id, text in rows:
            data = (text or "").encode()
            for i in range(len(data) - WINDOW + 1):
                s = data[i:i + WINDOW]
                first[s] = min(first.get(s, doc_id), doc_id)
        got = []
        for doc_id, text in rows:
            data = (text or "").encode()
            gone = [i for i in range(len(data) - WINDOW + 1) if data[i:i + WINDOW] in before or first[data[i:i + WINDOW]] < doc_id]
            starts, ends = covered(len(data), [(np.array(gone), np.array(gone) + WINDOW)]) if gone else ((), ())
            got.append((doc_id, int(sum(ends) - sum(starts)), len(starts)))
        before |= first.keys()
        out.append(sorted(got))
    return out


def test_batches_against_a_set_of_strings(spark, tmp_path):
    draw = random.Random(8)
    words = ["ab", "cde", "fgh ", "ij", "é", "klmno"]
    prose = lambda n: "".join(draw.choice(words) + " " for _ in range(n))
    shared = [prose(40) for _ in range(3)]
    batches, n = [], 100
    for b in range(5):
        rows = [(n + i, prose(draw.randint(0, 60)) + draw.choice([*shared, ""]) + prose(draw.randint(0, 30))) for i in range(12)]
        rows += [(n + 50, None), (n + 51, ""), (n + 52, "x" * 49), (n + 53, "y" * 300), (n + 53, "y" * 300)]
        if b:
            rows += [(n + 60, batches[-1][0][1]), (draw.randint(0, 90), shared[0])]  # an old text again, and a smaller id later
        batches.append(rows)
        n -= 7 if b == 2 else -100
    batches[3] = []
    path = f"file://{tmp_path}/family"
    for number, (rows, want) in enumerate(zip(batches, expected(batches), strict=True), 1):
        family = X.SuffixIndex(spark, path, buckets=3)  # opened again by each job
        got = family.add(spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, bucket string"))
        assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got.collect()) == want
        assert [size for _, size in family.levels] == [1 << i for i in range(5, -1, -1) if number >> i & 1]
    assert X.SuffixIndex(spark, path).buckets == 3
    kept = X.SuffixIndex(spark, path).add(spark.createDataFrame([(1, batches[0][0][1])], "doc_id long, text string"), content=True).first()
    data = batches[0][0][1].encode()
    assert bytes(kept.content) == (b"" if len(data) >= WINDOW else data)


def test_merge_by_ranks():
    draw = random.Random(3)
    for _ in range(60):
        parts = []
        for _ in range(2):
            data = np.array([draw.choice(b"ab") for _ in range(draw.randint(4, 30))], np.uint8)
            order, new = suffix_order(data, np.arange(len(data) - 3), 4)
            parts.append({"bytes": data, "order": order[new]})
        got = X.merged(*parts, 4)
        strings = X._strings(got["bytes"], got["order"], 4).tolist()
        every = {bytes(p["bytes"][i:i + 4]) for p in parts for i in range(len(p["bytes"]) - 3)}
        assert strings == sorted(every)
