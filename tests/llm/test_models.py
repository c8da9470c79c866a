"""Toxicity, language-model scores, nearest neighbours and main text."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hnsw, htmltext, lbl, toxicity
from tests.llm import brute
from tests.llm.conftest import SF

MID = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    rows = toxicity.toxic_grades(docs, train).join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("gold")), "doc_id").select("toxic", "gold", "severity", "grade").collect()
    hit = sum(r[0] == bool(r.gold) for r in rows)
    assert len(rows) > 50 and hit >= 0.95 * len(rows)
    assert all(0 <= r.severity <= toxicity.GRADES and 0 <= r.grade <= toxicity.GRADES for r in rows)


def test_toxicity_of_hard_rows(spark, docs, hard, none, clashing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (99, 1), (8, 1), (8, 0)], "doc_id long, toxic int")
    out = toxicity.toxic_grades(hard, labels)
    assert out.count() == hard.count() and toxicity.toxic_grades(clashing, labels).count() == hard.count()
    assert toxicity.toxic_grades(none, labels).count() == 0
    nothing = toxicity.toxic_grades(hard, labels.where("false"))
    assert nothing.where("severity > 0 OR toxic").count() == 0


def test_toxicity_against_plain_sums(spark, docs, hard):
    """Severity, grade and chance of every text from its features one by one."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    every = docs.select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    m = toxicity.fit(docs, labels)
    want = []
    for d in every.collect():
        s = sum(m.weights.get(h, 0.0) for h in {h for w in toxicity.words(d.text) for h in toxicity.features(w)})
        above = [1 / (1 + math.exp(t - s)) if m.weights else 0.0 for t in m.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        want.append((-1 if d.doc_id is None else d.doc_id, sum(j * p for j, p in enumerate(each)), each.index(max(each)), above[0]))
    got = [(-1 if r.doc_id is None else r.doc_id, r.severity, r.grade, r.p_toxic) for r in toxicity.score(every, m).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert (g[0], g[2]) == (w[0], w[2]) and math.isclose(g[1], w[1], abs_tol=1e-9) and math.isclose(g[3], w[3], abs_tol=1e-9)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    toxic = rng.random(400) < 0.3
    lists = [sorted({int(x) * 2 for x in rng.integers(0, 300, 20)} | ({2000, 2002, 2004} if t else set())) for t in toxic]
    m = toxicity.fit_grades(toxic, np.array([len(x) for x in lists]), np.concatenate(lists))
    assert m.thresholds == sorted(m.thresholds) and all(m.weights.get(h, 0) > 0 for h in (2000, 2002, 2004))


def test_lm_base_and_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r for r in lbl.lm_scores(docs).collect()}
    base = model = 0.0
    for (i, _), (held, n, known, total, score) in zip(rows, brute.lm_base(rows), strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and math.isclose(r.base_score, score, rel_tol=1e-9)
        if held:
            base, model = base + score, model + r.score
    assert model > base  # the model tells held-out texts better than word counts do


def test_lm_is_normalised():
    v = lbl.Vocabulary([b"\n"], np.array([1]), 1, 1, np.zeros(lbl.BUCKETS, np.int64), np.zeros(lbl.BUCKETS, np.int64), np.full(lbl.SYMBOLS, 1 / lbl.SYMBOLS))
    one, two, z = lbl.log_tables(lbl.initial(v))
    p = np.exp(one[3] + two[5] - z[3, 5])
    assert math.isclose(p.sum(), 1, rel_tol=1e-4)


def test_words_of_one_count_fill_the_table(spark, monkeypatch):
    """More words of one count than fit: some are symbols of their own all the same, and the sums agree."""
    monkeypatch.setattr(lbl, "TABLE", 2048)
    for first in (0, 50):
        words = [(f"w{i}", lbl.bucket(b"w%d" % i), 9 if i < first else 1) for i in range(9000)] + [(lbl.END, lbl.bucket(b"\n"), 5)]
        v = lbl.vocabulary(spark.createDataFrame(words, "word string, bucket int, c long"))
        assert v.words[0] == b"\n" and 2000 < len(v.words) <= 2048 and len(set(v.words)) == len(v.words)
        assert v.counts[1 : first + 1].tolist() == [9] * first and set(v.counts[first + 1 :].tolist()) == {1}
        assert v.n == 9000 + 8 * first + 5 and v.v == 9001
        assert v.bucket_v.sum() == 9001 - lbl.TOP and v.bucket_n.sum() == v.n - v.counts[: lbl.TOP].sum()


def test_lm_scores_against_plain_sums(spark, hard):
    """Every score by a softmax over all symbols, token by token, with the fitted parameters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    rows = lbl.split(docs)
    training = rows.where("NOT held_out")
    counts = lbl.token_counts(training)
    v = lbl.vocabulary(counts)
    params = lbl.fit(training, v)
    r, q, c1, c2, bias = (p.astype(np.float64) for p in params)
    count = {x.word.encode(): x.c for x in counts.collect()}
    symbol = {w: i for i, w in enumerate(v.words[: lbl.TOP])}
    of_class = defaultdict(list)
    for w, k in count.items():
        if w not in symbol:
            of_class[lbl.bucket(w)].append(k)
    memo = {}

    def chance(a, b, w):
        if (a, b) not in memo:
            x = (r[b] @ c1 + r[a] @ c2) @ q.T + bias
            memo[a, b] = x - x.max() - math.log(np.exp(x - x.max()).sum())
            assert math.isclose(np.exp(memo[a, b]).sum(), 1)
        s = symbol.get(w, lbl.TOP + lbl.bucket(w))
        out = memo[a, b][s] / math.log(10)
        if s >= lbl.TOP:
            own = of_class[s - lbl.TOP]
            out += math.log10((count.get(w, 0) + 0.1) / (sum(own) + 0.1 * (len(own) + 1)))
        return s, out

    want = []
    for d in sorted((x for x in docs.collect()), key=lambda x: len(x.text or ""))[:150]:
        a = b = 0
        total = 0.0
        for w in lbl.tokens(d.text):
            s, p = chance(a, b, w)
            total, a, b = total + p, b, s
        want.append((len(lbl.tokens(d.text)), total))
    got = sorted((x.n_tokens, x.score) for x in lbl.score(rows, counts, v, params).collect())
    for n, total in want:
        assert any(n == m and math.isclose(total, x, rel_tol=1e-4, abs_tol=1e-3) for m, x in got)


def test_lm_of_hard_rows(hard, none, clashing):
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lbl.lm_scores(hard).collect())
    want = sorted((n, k, round(b, 6)) for _, n, k, _, b in brute.lm_base([(r.doc_id, r.text) for r in hard.collect()]))
    assert got == want
    assert lbl.lm_scores(clashing).count() == hard.count() and lbl.lm_scores(none).count() == 0


def exact(rows, queries, k=5):
    out = {}
    for q, v in queries:
        v = np.asarray(v, float)
        near = sorted((-float(np.dot(v, x) / math.sqrt(np.dot(v, v) * np.dot(x, x))), i) for i, x in rows if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_nearest_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in df.collect()]
    got = defaultdict(dict)
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=64).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    want = exact(rows, [(i, v) for i, v in rows if i % 50 == 0])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert all(math.isclose(got[q][k + 1][1], s, rel_tol=1e-12) for q in want for k, (i, s) in enumerate(want[q]) if got[q][k + 1][0] == i)


def test_recall_of_routed_queries(spark):
    """Far more cells than a query visits, one of them with a third of all vectors."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(80, 24))
    of = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 80, 3000))
    rows = list(enumerate(centres[of] + 0.3 * rng.normal(size=(3000, 24))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    want = exact(rows, [(i, v) for i, v in rows if i % 50 == 0])
    got = defaultdict(set)
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=16, probe=24).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.9, 0.0]), (2, [0.1, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, -1.0]), (5, [0.0, -1.0])] + [(9, [1.0, 0.2 + k / 999]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 9), (4, 3), (5, 5)]
    assert math.isclose(got[0].score, 1.0) and math.isclose(got[4].score, 0.0, abs_tol=1e-12)


def test_nearest_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [-0.0, 1.0]), (50, [1.0, 0.0, 0.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"shard": F.lit(1), "v": F.lit(2), "ids": F.lit(3)})
    got = [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(df, df.where("vec_id IN (0, 3, 50)"), shard_rows=4).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, k + 1, i) for k, i in enumerate([1, 2, 100, 101, 102])]
    assert [i for q, _, i in got if q == 3] == [10, 0, 1, 2, 100] and not [q for q, _, _ in got if q == 50]
    assert hnsw.nearest(df.where("false"), df).count() == 0


def test_main_text(spark):
    trees = htmltext.model()
    right = total = 0
    for seed in range(9000, 9120):
        made = htmltext.made_page(seed)
        page = htmltext.parse(made)
        want = "\n".join(t for t, g in zip(page.text, page.gold, strict=True) if t and g)
        right += htmltext.main_texts([made.replace(" data-gold", "")], trees)[0] == want
        total += 1
    assert right >= 0.85 * total
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = htmltext.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) and r.text for r in rows)


def test_main_text_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "<script>x</script><style>p</style>"), (4, "<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>A title &amp; more</h1><p>First  long\nparagraph of the article, with words enough to count as text.<p>Second &lt;one&gt;, open to the end of the page and long enough too.</article><footer>&copy; us</footer></body></html>"),
        (4, "<p>" + "long text, very long. " * 5000 + "</p>"), (5, "<<<>>><a<b></p></div>&#x;"), (6, "<div>" * 3000 + "deep"),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.n_chars > 1000): r.text for r in got}
    assert by[1, False] == by[2, False] == by[3, False] == ""
    assert by[4, False] == "A title & more\nFirst long paragraph of the article, with words enough to count as text.\nSecond <one>, open to the end of the page and long enough too."
    assert htmltext.extract(df.where("false")).count() == 0


def test_decoding_never_contradicts():
    rng = np.random.default_rng(2)
    for seed in range(60):
        page = htmltext.parse(htmltext.made_page(seed))
        keep = htmltext.decode(page, rng.normal(0, 2, len(page.tag)))
        assert all(keep[p] for k, p in zip(keep[1:], page.parent[1:], strict=True) if k)


def test_unclosed_options_end_with_their_list():
    lists = "<select><option>A{0}<option selected>B{0}</select> <select><optgroup><option>C{0}<optgroup><option>D{0}</select><datalist><option>E{0}<option>F{0}</datalist>"
    text = "<p>" + "The article goes on for a while, with commas, and it ends here. " * 6 + "</p>"
    page = "<html><body><nav><a href='/'>Home</a></nav><div>{0}</div><form>Pick {1}</form><article><h1>Heading</h1>{2}</article></body></html>"
    closed = page.format("<option>S</option>", lists.format("</option>"), text * 3)
    unclosed = page.format("<option>S", lists.format(""), text * 3)
    assert htmltext.parse(unclosed) == htmltext.parse(closed)
    assert "The article goes on" in "".join(htmltext.parse(unclosed).text) and not {"A", "B", "C", "D", "E", "F", "S"} & set(htmltext.parse(unclosed).text)
    got = htmltext.main_texts([unclosed, closed], htmltext.model())
    assert got[0] == got[1] and got[0].count("The article goes on") == 18


PARAGRAPH = "The council met on Tuesday, and after a long debate it agreed to repair the old bridge. "
UNCLOSED = [
    "<div><button>Go</div>", "<header><noscript>no script</header>", "<div><svg><g><path d='x'><text>drawn</div>", "<form><textarea>typed <b>here</form>", "<div><select><option>a<option>b</div>",
    "<button>Go", "<select><option>a<optgroup><option>b", "<textarea>typed", "<form><textarea><div>typed</div><p>more</p></textarea></form>", "<div><svg><div>in</div></svg></div>", "<nav><a href='/'><svg></a></nav>",
    "<div><object><p>fallback</div>", "<aside><video><track><p>no video</aside>",
]


@pytest.mark.parametrize("before", UNCLOSED)
def test_no_page_is_lost_to_unclosed_elements(before):
    page = f"<html><body>{before}<article><h1>The bridge</h1><p>{PARAGRAPH * 3}</p><p>{PARAGRAPH * 2}</p></article></body></html>"
    got = htmltext.main_texts([page], htmltext.model())[0]
    assert got == "\n".join(["The bridge", (PARAGRAPH * 3).strip(), (PARAGRAPH * 2).strip()])


def test_pages_written_by_hand():
    """Pages of other makes than the rule's, with their main text written beside them."""
    long, other = PARAGRAPH * 4, "Work will start in spring, the mayor said, and traffic will be led over the new road until then. " * 2
    pages = [
        (f"<body><div id=wrap><div class='site-header'><a href=/>Daily</a></div><div class='entry-content'><h2>Bridge</h2><p>{long}<p>{other}</div><div class=sidebar><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div></div>", ["Bridge", long, other]),
        (f"<body><main><article><p>{long}</p><ul><li>First point of three</li><li>Second point, longer</li></ul><p>{other}</p></article></main><section id=comments><h3>2 comments</h3><div class=comment><p>Great news, thanks a lot for writing about it!</p></div></section><footer><p>Copyright by the paper</p></footer>", [long, "First point of three", "Second point, longer", other]),
        (f"<body><div class='cookie-banner'>We use cookies. <button>Fine</button></div><nav><ul><li><a href=a>Home</a></li><li><a href=b>Sport</a></li></ul></nav><article><h1>A &amp; B</h1><p>{long}</p><blockquote><p>{other}</p></blockquote></article><aside class=related><h4>Read on</h4><a href=c>Another story</a></aside>", ["A & B", long, other]),
    ]
    got = htmltext.main_texts([html for html, _ in pages], htmltext.model())
    assert got == ["\n".join(t.strip() for t in want) for _, want in pages]
