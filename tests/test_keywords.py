import glob
import json

import pytest
from conftest import rows
from golden import SENTIMENT_TOTALS, TONE_MEANS
from pyspark.sql import functions as F

from tidemark.functions.constants import WATCHED
from tidemark.operators import asof
from tidemark.operators import keywords as K
from tidemark.plans import reports
from tidemark.schemas import TONE_POST
from tidemark.sources.posts import read_posts


def write_posts(path, posts):
    path.mkdir()
    lines = [p if isinstance(p, str) else json.dumps(p) for p in posts]
    (path / "posts.json").write_text("\n".join(lines) + "\n")
    return str(path)


def post(tags, sentiment="neutral", tones=()):
    return {
        "entities": {"hashtags": [{"text": t} for t in tags]},
        "tone": {
            "sentiment": sentiment,
            "document_tone": {"tones": [{"tone_name": n, "score": s} for n, s in tones]},
        },
    }


def csv_bytes(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_sentiment_report_gives_the_known_bytes(spark, tmp_path):
    golden = [line.split(",") for line in SENTIMENT_TOTALS.split()]
    posts = [post([tag], mood) for tag, mood, total in golden for _ in range(int(total))]
    posts += [post(["Healthcare"]), post([]), post(["unlisted"], "unheard of")]
    source, out = write_posts(tmp_path / "in", posts), str(tmp_path / "out")
    reports.sentiment_report(spark, source, out)
    assert len(glob.glob(f"{out}/part-*")) == 1
    assert csv_bytes(out) == SENTIMENT_TOTALS.replace("\n", "\r\n").encode()


def test_tone_report_gives_the_known_means(spark, tmp_path):
    golden = [line.split(",") for line in TONE_MEANS.split()]
    posts = []
    for tag, tone, score, mood, total in golden:
        signed = round(float(mood) * int(total))
        moods = ["positive" if signed > 0 else "negative"] * abs(signed)
        moods += ["neutral"] * (int(total) - len(moods))
        posts += [post([tag], m, [(tone, float(score))]) for m in moods]
    source, out = write_posts(tmp_path / "in", posts), str(tmp_path / "out")
    reports.tone_report(spark, source, out)
    found = [line.split(",") for line in csv_bytes(out).decode().split()]
    assert [(f[0], f[1], f[4]) for f in found] == [(g[0], g[1], g[4]) for g in golden]
    for f, g in zip(found, golden):
        assert float(f[2]) == pytest.approx(float(g[2]), abs=1e-9)
        assert float(f[3]) == pytest.approx(float(g[3]), abs=1e-9)


EDGES = [
    {"entities": None, "tone": None},
    {"entities": {"hashtags": None}},
    post([]),
    post(["unlisted"], "unheard of", [("Joy", 0.5)]),
    post(["Healthcare"]),
    post(["nra", "nra"], "positive"),
    {"entities": {"hashtags": [{"text": "daca"}]}, "tone": None},
    post(["daca"], "negative", []),
    post(["thewall", "shooting"], "negative", [("Joy", 0.5), ("Fear", 0.75), ("Anger", 1.0)]),
    post(["medicaid"], "unheard of", []),
    "{ this is no JSON",
]


def test_edge_rows(spark, tmp_path):
    posts = read_posts(spark, write_posts(tmp_path / "in", EDGES), TONE_POST)
    counts = K.keyword_sentiment_counts(posts)
    assert [tuple(r) for r in counts.collect()] == [
        ("daca", None, 1),
        ("daca", "negative", 1),
        ("medicaid", "unheard of", 1),
        ("nra", "positive", 2),
        ("shooting", "negative", 1),
        ("thewall", "negative", 1),
    ]
    means = [tuple(r) for r in K.keyword_tone_means(posts).collect()]
    tones = [("Anger", 1.0), ("Fear", 0.75), ("Joy", 0.5)]
    assert means == [(t, n, s, -1.0, 1) for t in ("shooting", "thewall") for n, s in tones]
    assert counts.agg(F.sum("total")).first()[0] == 7


def test_strict_and_lenient_sentiments(spark, tmp_path):
    bad = [post(["nra"], "unheard of", [("Joy", 0.5)]), post(["nra"], "positive", [("Joy", 1.0)])]
    posts = read_posts(spark, write_posts(tmp_path / "in", bad), TONE_POST)
    with pytest.raises(Exception, match="unknown sentiment: unheard of"):
        K.keyword_tone_means(posts).collect()
    assert rows(K.keyword_tone_means(posts, strict=False)) == [("nra", "Joy", 0.75, 1.0, 2)]


def test_missing_sentiment_fails_strictly(spark, tmp_path):
    bad = [post(["nra"], None, [("Joy", 0.5)])]
    posts = read_posts(spark, write_posts(tmp_path / "in", bad), TONE_POST)
    with pytest.raises(Exception, match="unknown sentiment: null"):
        K.keyword_tone_means(posts).collect()


def test_watch_list_as_table_or_long_list_equals_literal(spark, tmp_path):
    posts = read_posts(spark, write_posts(tmp_path / "in", EDGES), TONE_POST)
    as_table = spark.createDataFrame([(w,) for w in WATCHED], "w string")
    as_long_list = WATCHED + [f"other{i}" for i in range(2000)]
    for report in (K.keyword_sentiment_counts, K.keyword_tone_means):
        expected = report(posts).collect()
        assert report(posts, as_table).collect() == expected
        assert report(posts, as_long_list).collect() == expected


def test_weights_equal_repetition(spark):
    tones = "array(named_struct('tone_name', 'a', 'score', 0.5D), named_struct('tone_name', 'b', 'score', id / 10D))"
    base = spark.range(5).selectExpr(
        "concat('k', id % 2) AS hashtag", "'positive' AS sentiment", f"{tones} AS tones", "id + 1 AS n"
    )
    repeated = base.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("i")
    weighted = K.tone_means(K.tone_sums(base, weight="n")).orderBy("hashtag", "tone").collect()
    plain = K.tone_means(K.tone_sums(repeated)).orderBy("hashtag", "tone").collect()
    for w, p in zip(weighted, plain, strict=True):
        assert (w[0], w[1], w[4]) == (p[0], p[1], p[4])
        assert w[2] == pytest.approx(p[2]) and w[3] == pytest.approx(p[3])


def test_tag_text_reports(spark, tmp_path):
    texts = [("x #a", "NY"), ("x  #b y", "NY"), ("\ty\n#a", "CA"), ("one", "CA"), ("", "CA"), (None, "CA")]
    source = write_posts(tmp_path / "in", [{"hashtags": t, "state": s} for t, s in texts])
    popular = reports.popularity_report(spark, source)
    assert [tuple(r) for r in popular.collect()] == [(1, "#b"), (2, "#a")]
    assert rows(reports.region_report(spark, source)) == [("CA", "#a", 1), ("NY", "#a", 1), ("NY", "#b", 1)]
    top = reports.region_report(spark, source, k=1)
    assert rows(top, "state", "hashtag", "rank") == [("CA", "#a", 1), ("NY", "#a", 1)]


def test_value_runs(spark):
    pairs = [("a", "y"), ("a", "x"), ("a", "y"), ("a", ""), ("b", "zzz"), ("b", None), ("c", "q" * 9)]
    df = spark.createDataFrame(pairs, "k string, v string")
    assert rows(K.value_runs(df, "k", "v")) == [
        ("a", "", 1), ("a", "x", 1), ("a", "y", 2), ("b", "zzz", 1), ("c", "q" * 9, 1)
    ]


@pytest.mark.parametrize("part_rows", [20, 1000])
def test_positions_of_runs_give_any_slice(spark, monkeypatch, part_rows):
    monkeypatch.setattr(asof, "CUT_SAMPLE", 5)
    pairs = [("a", f"v{n % 211:x}é") for n in range(0, 3000, 7)] + [("b", "xy")] * 5 + [("b", ""), (None, "n"), (None, "m"), ("c", None)]
    runs = K.value_runs(spark.createDataFrame(pairs, "k string, v string"), "k", "v")
    placed = K.run_positions(runs, "k", "v", part_rows=part_rows)
    assert placed.columns == ["k", "v", "copies", "start", "n_chars"]
    for key in ("a", "b", None):
        text = "".join(sorted(v for k, v in pairs if k == key and v is not None))
        own = placed.where(F.col("k").eqNullSafe(F.lit(key)))
        assert {r["n_chars"] for r in own.collect()} == {len(text)}
        assert all(text[r["start"] :].startswith(r["v"] * r["copies"]) for r in own.collect())
        for low, high in ((0, len(text)), (3, 8), (2, 3), (len(text) - 2, len(text) + 9), (5, 5)):
            assert "".join(r["piece"] for r in K.text_slice(own, "v", low, high).collect()) == text[low:high]
