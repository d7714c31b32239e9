"""Sharding, quality rules, language ID, decontamination, HTML text and LM scoring against brute force and fixtures."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, html_text, langid, lm, quality, sharding

from .conftest import prose

import random


def test_shards_follow_the_key_law(spark, docs, none, rows):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({r.doc_id for r in got})
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert sharding.shard(none).collect() == []
    many = sharding.shard(spark.range(20000).selectExpr("id AS doc_id", "'x' AS text"))
    n = many.groupBy("shard").count().collect()
    assert len(n) == 8 and all(abs(r["count"] - 2500) < 250 for r in n)
    assert abs(many.where("grown_shard = 8").count() - 20000 / 9) < 250


def test_changed_weights_move_keys_only_in_their_subtree(spark):
    t = sharding.tree()
    r0, r1 = t.children
    k0, k1 = r0.children
    # two shards of one rack trade weight: no other subtree changes
    traded = sharding.Node("root", (sharding.Node("r0", (sharding.Node("k0", (sharding.Node("s0", shard=0, own=1.5), sharding.Node("s1", shard=1, own=0.5))), k1)), r1))
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    moved = df.select(sharding.placed(F.col("k"), t).alias("a"), sharding.placed(F.col("k"), traded).alias("b")).where("a <> b").collect()
    assert moved and all({r.a, r.b} <= {0, 1} and r.b == 0 for r in moved)


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, none, rows):
    extra = ["a b c d e f g h x a b c d e f g h y a b c d e f g h", "\n".join(["same line here"] * 9), "# * $ " * 20]
    more = docs.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    got = quality.judged(more).collect()
    want = Counter((i, *(c := counted(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in [(r[0], r[1]) for r in rows] + [(9000 + i, t) for i, t in enumerate(extra)])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judged(none).collect() == []
    kept = quality.kept_only(more)
    assert kept.columns == more.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_outliers_of_a_group_go_and_others_stay(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, rng.randint(60, 300)), "en", "a") for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "a") for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(30))


def test_mild_symbol_junk_goes_and_repeats_below_the_base_rule_stay(spark):
    rng = random.Random(9)
    good = [(i, prose(rng, rng.randint(60, 300)), "en", "a") for i in range(300)]
    junk, twice = [], []
    for i in range(5):
        w = prose(rng, 100).split()
        junk.append((1000 + i, " ".join(x + "#" * (j % 5 < 2) for j, x in enumerate(w)), "en", "a"))
        twice.append((2000 + i, " ".join(w[:60] + w[40:52] + w[60:88]), "en", "a"))  # 24 of 100 words repeat
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(good + junk + twice, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].distance < 120 and not got[i].kept for i in range(1000, 1005))
    assert all(got[i].n_repeat_words >= 20 and got[i].kept for i in range(2000, 2005)) and all(got[i].kept for i in range(300))


def test_junk_of_two_fifths_of_a_group_does_not_hide_itself(spark):
    rng = random.Random(10)
    good = [(i, prose(rng, rng.randint(60, 300)), "en", "a") for i in range(180)]
    bad = [(1000 + i, " ".join(w + "#" * rng.randint(1, 6) for w in prose(rng, 100).split()), "en", "a") for i in range(120)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(180)) and not any(got[1000 + i] for i in range(120))


def determinant(x, start=None):
    """Concentration steps by definition on the rows of x: centre, covariance with the floors, and its log determinant."""
    half_up = lambda v: np.floor(v * 100 + 0.5) / 100
    floor = np.diag(np.square(quality.FLOOR))
    if start is None:
        m = np.percentile(half_up(x), 50, axis=0)
        spread = np.percentile(half_up(np.abs(x - m)), 50, axis=0)
        return m, np.diag((1.4826 * spread) ** 2) + floor
    m, c = start
    mark = half_up(np.log(distances(x, m, c) + 1e-9))
    kept = x[mark <= np.percentile(mark, 100 * quality.SHARE) + 1e-12]
    return kept.mean(0), np.cov(kept.T, bias=True) * quality.consistency(quality.SHARE) + floor


def distances(x, m, c):
    return np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)


def test_verdicts_equal_a_second_estimate(spark):
    rng = random.Random(21)
    rows = []
    for i in range(700):
        t = prose(rng, rng.randint(25, 200))
        if i % 9 == 0:
            t = " ".join(w + "#" * rng.randint(0, 5) for w in t.split())
        rows.append((i, t, ["en", "fr", None][i % 3] if i < 690 else "xx", "s"))
    stats = [counted(t) for _, t, *_ in rows]
    n, chars, symbols, lines, repeats = np.array(stats, float).T
    ok = (n >= 20) & (100 * repeats <= 30 * n)
    x = np.stack([np.log1p(n), np.log((chars + 1) / np.maximum(n, 1)), np.sqrt(symbols / (chars + 1)), np.sqrt(lines / np.maximum(n, 1)), np.sqrt(repeats / np.maximum(n, 1))], axis=1)
    names = [(lang, source) for _, _, lang, source in rows]
    big = {g for g, k in Counter(g for g, o in zip(names, ok) if o).items() if k >= quality.LEAST}
    group = np.array([repr(g) if g in big else "" for g in names])
    models = {g: determinant(x[ok & (group == g)]) for g in set(group)}
    for step in range(quality.STEPS):
        last, models = models, {g: determinant(x[ok & (group == g)], m) for g, m in models.items()}
        if step and not any(np.linalg.slogdet(models[g][1])[1] < np.linalg.slogdet(last[g][1])[1] - quality.STILL for g in models):
            break
    d2 = np.array([distances(x[i : i + 1], *models[group[i]])[0] for i in range(len(rows))])
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    clear = [i for i in range(len(rows)) if abs(d2[i] / quality.REJECT - 1) > 0.02]
    assert len(clear) > 680 and all(got[i].kept == bool(ok[i] and d2[i] <= quality.REJECT) for i in clear)
    assert all(abs(got[i].distance / d2[i] - 1) < 0.01 for i in range(len(rows)) if d2[i] > 1e-6)
    assert 20 < sum(not r.kept for r in got.values()) < 200


def test_consistency_factor():
    rng = np.random.default_rng(0)
    r = np.sort((rng.standard_normal((200_000, 5)) ** 2).sum(1))
    assert abs(quality.consistency(0.75) - 5 / r[: int(0.75 * len(r))].mean()) < 0.02


LANGS = {"en": "the and ing th er with house tree".split(), "fr": "le la eau oux été est maison arbre".split(), "de": "der die und sch über ung haus baum".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGS[lang]) + rng.choice(LANGS[lang]) for _ in range(rng.randint(3, 60))), lang) for i in range(600) for lang in [rng.choice(list(LANGS))]]
    return spark.createDataFrame(rows + [(9001, None, "en"), (9002, "12 !!", "fr"), (9003, "", None)], "doc_id long, text string, lang string")


def test_language(labelled, docs, none):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(labelled, ~held)
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.identify(labelled, model).collect()}
    truth = {r.doc_id: r.lang for r in labelled.where(held & (F.col("doc_id") < 9000)).collect()}
    assert sum(got[i].lang_pred == x for i, x in truth.items()) >= 0.98 * len(truth)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (9001, 9002, 9003))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, model).count() == docs.count()
    assert langid.identify(none, model).collect() == []
    kept = langid.accepted_only(labelled, model)
    assert kept.columns == labelled.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.accepted}
    empty = langid.fit(none.select("doc_id", "text", "lang"), ~held)
    assert {r.lang_pred for r in langid.identify(labelled, empty).collect()} == {"und"}


def test_rejection_threshold():
    logits = np.array([[4.0, 0], [3, 0], [0, 3], [0.2, 0], [0, 0.1]])
    t, cut = langid.calibrated(logits, np.array([0, 0, 1, 1, 0]), 0.99)
    p = langid._softmax(logits / t).max(1)
    assert cut == pytest.approx(p[:3].min())


def tiled(doc, item, least):
    """Greedy tiling by definition: again and again the longest common stretch of unmarked words."""
    fd, fi, out = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and fd[i + n] and fi[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        fd[i : i + n], fi[j : j + n], out = [False] * n, [False] * n, out + n


def test_tiles_cover_as_by_definition():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(5, 40))]
        cut = rng.randrange(1, len(item))
        doc = [rng.randrange(6) for _ in range(rng.randint(0, 30))] + item[cut:] + [9] + item[:cut] + [rng.randrange(6) for _ in range(10)]
        d, i = np.array(doc, np.uint64) + 1, np.array(item, np.uint64) + 1
        got = decontamination.tiles(d, i, 4)
        assert all((d[a : a + n] == i[b : b + n]).all() for a, b, n in got)
        assert sum(n for *_, n in got) == tiled(doc, item, 4)


def test_contaminated(spark, docs, none):
    rng = random.Random(5)
    items = [(k, prose(rng, 40)) for k in range(4)] + [(4, "tiny item"), (5, None), (None, "no id"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    w = items[0][1].split(" ")
    planted = [(1, "before " + items[1][1].upper() + " after"), (2, " ".join(w[20:]) + " middle words " + " ".join(w[:20])), (3, " ".join(items[2][1].split(" ")[:10])), (4, "a tiny item here"), (5, None), (6, "clean text of no item")]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 0), (4, 4)}
    assert got[2, 0].tiles >= 2 and got[2, 0].coverage >= 0.9
    assert {r.doc_id for r in decontamination.without_contaminated(df, bench).collect()} == {3, 5, 6}
    assert decontamination.contaminated(df, bench.where("false")).collect() == [] and decontamination.contaminated(none, bench).collect() == []
    assert decontamination.without_contaminated(docs, bench).columns == docs.columns


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, 30)) for k in range(7)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    got = decontamination.contaminated(df, df.withColumnRenamed("doc_id", "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(k, k) for k in range(7)}


def by_definition(rows):
    """Text of pages by the rule: named elements as html_text.lines() has them; any other line stays unless the page of its host
    whose address shares the longest beginning holds it in a longest common subsequence. For pages whose lines are all different."""
    found = {i: (html_text.address(u), html_text.lines(h)) for i, u, h in rows}
    out = {}
    for i, ((host, path), mine) in found.items():
        near = sorted(((p, [t for t, _ in other]) for (h, p), other in found.values() if host and h == host and p != path and other), key=lambda x: x[0])
        before, after = [x for x in near if x[0] < path][-1:], [x for x in near if x[0] > path][:1]
        best = max(before + after, key=lambda x: html_text._prefix(x[0], path), default=(None, []))[1]
        own, same = [t for t, _ in mine], set()
        k, other = 0, list(best)
        table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for a in range(len(own)):
            for b in range(len(other)):
                table[a + 1][b + 1] = table[a][b] + 1 if own[a] == other[b] else max(table[a][b + 1], table[a + 1][b])
        a, b = len(own), len(other)
        while a and b:
            if own[a - 1] == other[b - 1]:
                same.add(own[a - 1])
                a, b = a - 1, b - 1
            elif table[a - 1][b] >= table[a][b - 1]:
                a -= 1
            else:
                b -= 1
        out[i] = "\n".join(t for t, kind in mine if kind == html_text.TEXT or (kind == html_text.UNDECIDED and t not in same))
    return out


def test_pages_without_hints_are_decided_by_their_neighbours(spark):
    """Templates and texts in bare blocks: no element says what it is."""
    rng = random.Random(31)
    rows = []
    for host in range(6):
        top, end = [prose(rng, 4) + f" {host}t{k}" for k in range(4)], [prose(rng, 4) + f" {host}e{k}" for k in range(3)]
        for k in range(20):
            body = [prose(rng, 12).replace("\n", " ") + f" {host}/{k}/{j}" for j in range(rng.randint(1, 6))]
            ad = [f"offer {host}{k} {prose(rng, 3)}"] if k % 4 == 0 else []
            rows.append((host * 100 + k, f"http://h{host}.example/{k % 5}/{k}", "".join(f"<div>{x}</div>" for x in top + ad + body + end)))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == by_definition(rows)
    undecided = sum(k == html_text.UNDECIDED for _, _, h in rows for _, k in html_text.lines(h))
    kept = sum(len(t.split("\n")) for t in got.values())
    assert undecided == sum(len(html_text.lines(h)) for *_, h in rows) and undecided - kept == len(rows) * 7  # all template lines, and no other


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav>{top}<article><h1>Head {k} &amp; more</h1><p><b>Bold\n  text {k}<br><p>Second&nbsp;par<script>var x='</p>'</script> end</article><div class=\"ad\">Buy {k}</div><section id='comments'><p>nice {k}</p></section><footer>&copy; x</footer></body></html>"


def test_html(spark):
    bare = "<div>Site menu line</div><div><p>Own words of page {k}.</p><table><tr><td>a</td><td>b{k}</td></tr></table></div><div>Imprint line</div>"
    rows = [(k, f"https://a.example/en/{k}.html?x=1", PAGE.replace("{k}", str(k)).replace("{top}", "")) for k in range(3)]
    rows += [(10 + k, f"http://b.example/p/{k}/", bare.replace("{k}", str(k))) for k in range(4)]
    rows += [(20, None, bare), (21, "http://b.example/p/9", None), (22, "::bad", ""), (23, "http://c.example/x", "plain &lt;text&gt;"), (24, "http://b.example/p/0#again", bare.replace("{k}", "0")), (25, "http://d.example/", "<p>unclosed <nav>gone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS shared", "3 AS text")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert len(got) == len(rows)
    assert got[1].text == "Head 1 & more\nBold text 1\nSecond par end" and got[1].n_chars == len(got[1].text)
    for k in range(4):
        assert got[10 + k].text == f"Own words of page {k}.\na b{k}"
    assert got[24].text == got[10].text
    assert got[20].text.startswith("Site menu line") and got[23].text == "plain <text>" and got[25].text == "unclosed"
    assert got[21].text == got[22].text == "" and got[21].n_chars == 0
    assert html_text.main_text(df.where("false")).collect() == []


def test_pages_that_differ_by_query_or_share_a_url_lose_their_template(spark):
    bare = "<div>Site menu line</div><div>Own words of page {k}.</div><div>Imprint line</div>"
    rows = [(k, f"http://q.example/index.php?id={k}", bare.replace("{k}", str(k))) for k in range(3)]
    rows += [(10 + k, f"http://r.example/p/{k}", bare.replace("{k}", str(k))) for k in range(2)]
    rows += [(20, "http://r.example/p/0", None), (21, "http://r.example/p/1", ""), (22, "http://r.example/p/0", bare.replace("{k}", "new"))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = "Own words of page {}.".format
    assert got == {0: own(0), 1: own(1), 2: own(2), 10: own(0), 11: own(1), 20: "", 21: "", 22: own("new")}


def test_common_subsequence():
    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(7)
    for _ in range(300):
        a, b = rng.sample(range(30), rng.randint(0, 20)), rng.sample(range(30), rng.randint(0, 20))
        assert len(html_text.shared(a, b)) == longest(a, b)


def test_lm(docs, none, rows):
    toks = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i, *_ in rows]
    c = Counter(w for t, ok in zip(toks, train) if ok for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], not ok, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, ok in zip(rows, toks, train))
    got = lm.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm.score(none).collect() == []
    only = lm.score(docs.where("crc32(cast(doc_id AS string)) % 7 = 2"))
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in only.collect())


def test_lm_classes_are_distributions():
    rng = np.random.default_rng(1)
    m = lm.classes(rng.poisson(0.3, (40, 40)))
    assert np.allclose(m.sum(1), 1) and (m > 0).all()


def test_lm_words_are_a_distribution():
    w = lm.Words([(1, 500), (2, 100), (7, 20), (300, 3)])
    total = sum(n * float(w.probability(np.array([c]))[0]) for c, n in [(1, 500), (2, 100), (7, 20), (300, 3)]) + float(w.probability(np.array([0]))[0])
    assert total == pytest.approx(1, abs=1e-6)


def test_lm_tables_follow_their_conditional_distribution():
    """Against all seatings of a dish, and, beyond the exact table, against the law's own recursion."""

    def mean(n, rest, base, d):
        out = np.full(n + 1, -np.inf)  # logarithms, by number of tables
        out[1] = np.log(rest * base)
        with np.errstate(divide="ignore"):
            for k in range(1, n):
                t = np.arange(1, n + 1)
                new = np.append(-np.inf, out[1:-1] + np.log((rest + d * t[:-1]) * base))
                out[1:] = np.logaddexp(new, out[1:] + np.log(np.maximum(k - d * t, 0)))
        w = np.exp(out - out.max())
        return float((np.arange(n + 1) * w).sum() / w.sum())

    rng = np.random.default_rng(2)
    for n, rest, base, d in ((2, 3.0, 0.2, 0.6), (9, 12.0, 0.3, 0.6), (40, 2.0, 0.05, 0.5), (64, 100.0, 0.5, 0.6), (120, 40.0, 0.1, 0.6), (120, 3.0, 0.02, 0.5), (150, 4000.0, 0.3, 0.6), (3000, 50.0, 0.2, 0.6)):
        want = mean(n, rest, base, d)
        got = lm.drawn(np.full(4000, n), np.full(4000, rest), np.full(4000, base), d, rng).mean()
        assert abs(got / want - 1) < (0.03 if n <= lm.EXACT else 0.08), (n, rest, base, got, want)


def test_word_hashes():
    import pyarrow as pa

    texts = ["The THE the", None, "", "  lead\ttrail\n", "averyverylongwordindeed averyverylongwordindeeD", "café cafÉ"]
    h, row = lm.tokens(pa.array(texts))
    assert np.bincount(row).tolist() == [4, 1, 1, 3, 3, 3]
    assert len(set(h[row == 0].tolist())) == 2 and len(set(h[row == 4].tolist())) == 2 and len(set(h[row == 5].tolist())) == 3


def test_lm_scores_word_pairs_after_frequent_and_other_contexts(spark, monkeypatch):
    rng = random.Random(8)
    fill = [f"w{i}" for i in range(600)]
    texts = [" ".join(["top"] + [rng.choice(fill) for _ in range(100)]) for _ in range(600)]
    for i in range(40):  # 'other' and 'none' have equal counts, all outside the classes; 'top' has a class of its own
        texts.append(f"top other {rng.choice(fill)} none {rng.choice(fill)} some other {rng.choice(fill)} none")
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    held = [i for i in range(20_000, 30_000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    asked = ["top other", "top none", "some other", "some none"]
    df = spark.createDataFrame([*zip(ids, texts), *zip(held, asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df).collect()}
    a, b, c, d = (got[i] for i in held)
    assert a > b + 0.5 and c > d + 0.5
    # hot contexts, dealt over buckets by word, give what whole ones give
    monkeypatch.setattr(lm, "HOT", 0)
    whole = {r.doc_id: r.score for r in lm.score(df).collect()}
    assert all(abs(got[i] - whole[i]) < 0.02 * abs(whole[i]) for i in got)


def restaurant(counts, base, rng, sweeps=4000, burn=500, strength=lm.STRENGTH, discount=lm.D_CONTEXT):
    """Predictive probabilities of a Pitman-Yor restaurant by definition: single customers leave and sit down again, table by table."""
    tables = {w: [] for w, n in enumerate(counts) if n}
    total = 0
    out = np.zeros(len(counts))

    def sit(w, t_all):
        old = [s - discount for s in tables[w]]
        new = (strength + discount * t_all) * base[w]
        u = rng.random() * (sum(old) + new)
        for k, x in enumerate(old):
            u -= x
            if u < 0:
                tables[w][k] += 1
                return t_all
        tables[w].append(1)
        return t_all + 1

    for w, n in enumerate(counts):
        for _ in range(n):
            total = sit(w, total)
    customers = [w for w, n in enumerate(counts) for _ in range(n)]
    for sweep in range(sweeps):
        for w in customers:
            k = rng.choices(range(len(tables[w])), tables[w])[0]
            tables[w][k] -= 1
            if not tables[w][k]:
                tables[w].pop(k)
                total -= 1
            total = sit(w, total)
        if sweep >= burn:
            out += [(n - discount * len(tables.get(w, ())) + (strength + discount * total) * base[w]) / (strength + sum(counts)) for w, n in enumerate(counts)]
    return out / (sweeps - burn)


def test_lm_contexts_agree_with_a_sampler_by_definition():
    base = np.array([0.3, 0.25, 0.2, 0.1, 0.08, 0.04, 0.02, 0.01])
    for counts in ([9, 4, 0, 2, 1, 0, 0, 1], [1, 1, 0, 0, 0, 0, 0, 0], [25, 0, 6, 0, 0, 3, 0, 0]):
        want = restaurant(counts, base, random.Random(1))
        at, n = np.zeros(8, np.int64), np.array(counts)
        got = np.mean([lm.contexts(at, n, base, np.array([n.sum()]), np.array([np.nan]), np.random.default_rng(k)) for k in range(200)], axis=0)
        assert np.abs(np.log(got / want)).max() < 0.04, (counts, got, want)


def test_lm_contexts_are_distributions():
    rng = np.random.default_rng(3)
    at, base = np.repeat(np.arange(4), 50), np.full(200, 1 / 50)
    n = rng.poisson(2, 200) * (at > 0)
    p = lm.contexts(at, n, base, np.bincount(at, n), np.full(4, np.nan), rng)
    assert np.allclose(np.bincount(at, p), 1) and np.allclose(p[:50], 1 / 50)
