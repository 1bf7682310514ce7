import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pothika.functions import similarity, text

SHORT = st.text("abcक", max_size=9)


def naive(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@given(SHORT, SHORT)
def test_common_length_and_ratio(a, b):
    assert similarity.common_length(a, b) == naive(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a) <= similarity.length_bound(len(a), len(b)) + 1e-9


@given(st.text("ab", min_size=1, max_size=5), st.text("abc", min_size=5, max_size=14))
def test_best_window(q, t):
    best = (0.0, 0, 0)
    for at in range(1 - len(q), len(t)):
        s, e = max(0, at), min(len(t), at + len(q))
        if (x := 200.0 * naive(q, t[s:e]) / (len(q) + e - s)) > best[0]:
            best = (x, s, e)
    assert similarity.best_window(q, t) == best


def test_text_expressions_follow_python(spark):
    texts = ["", None, "નમો  અરિહંતાણં ।। १२ ||", "ड़ो​\tx\x07", "क़ख़ णषश ब्वी"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, light, key in rows.select("i", text.light(F.col("t")), text.key(F.col("t"))).collect():
        assert light == text.py_light(texts[i])
        assert key == text.py_key(texts[i])


def test_many_windows_at_once():
    rnd = random.Random(6)
    queries, texts = [], []
    for _ in range(400):
        letters = rnd.choice(["कग", "कखगघचछजझ"])
        q, t = ("".join(rnd.choice(letters) for _ in range(n)) for n in (rnd.randint(1, 30), rnd.randint(0, 90)))
        queries.append(q)
        texts.append(t + "".join(c for c in q if rnd.random() < 0.9) + t[:9] if rnd.random() < 0.5 else t)
    assert similarity.best_windows(queries, texts) == [similarity.best_window(q, t) for q, t in zip(queries, texts)]
    assert similarity.best_windows(["कग"] * 5000, ["गकगक"] * 5000) == [(100.0, 1, 3)] * 5000
    assert similarity.best_windows([], []) == [] and similarity.best_windows(["क"], ["ख"]) == [(0.0, 0, 0)]
