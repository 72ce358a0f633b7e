"""fuzzy_token_sort against brute force over whole texts."""

import re

from tallyloom.plans import retrieval

TEXTS = ["one two three four five six seven EIGHT", "eight seven one two three four five six", "one two three four five six nine ten", "alone", "b a  one"]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def test_whole_texts_of_all_items_that_share_a_token(spark, tmp_path):
    spark.createDataFrame([(3 * k, x) for k, x in enumerate(TEXTS)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["q"], r["d"]): r["ratio"] for r in retrieval.BOOK.queries["fuzzy_token_sort"](spark, str(tmp_path)).collect()}
    words = [sorted(re.split(r"\s+", x.lower())) for x in TEXTS]
    want = {}
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            if i != j and set(x) & set(y):
                a, b = " ".join(x), " ".join(y)
                want[3 * i, 3 * j] = round(2 * common(a, b) / (len(a) + len(b)), 6)
    assert got == want and got[0, 3] == 1
