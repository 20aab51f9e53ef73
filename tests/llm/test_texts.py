from __future__ import annotations

import hashlib
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from harborlight.llm import chat, decontam, html, langid, quality, substring

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ral", "tin", "mop", "sed")]


def prose(random, n):
    return " ".join(random.choice(WORDS, n))


# decontamination


def items_and_docs():
    random = np.random.default_rng(5)
    items = [(k, prose(random, 20 + k)) for k in range(8)]
    docs = [(100 + k, prose(random, 60)) for k in range(20)]
    w = items[3][1].split()
    every_fifth = [x if i % 5 else "zzz" for i, x in enumerate(w, 1)]
    docs += [(1, f"{prose(random, 30)} {items[0][1].upper()}! {prose(random, 5)}"), (2, items[1][1]), (3, " ".join(items[2][1].split()[:14])), (4, f"{prose(random, 9)} {' '.join(every_fifth)}"), (5, " ".join(w[:8]))]
    return items, docs + [(None, items[5][1]), (7, None), (8, ""), (2, items[1][1])]


def frames(spark):
    items, docs = items_and_docs()
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    return bench, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS _h", "3 AS n_tokens")


@pytest.mark.parametrize("rows", [200_000, 0])
def test_contaminated(spark, rows):
    bench, docs = frames(spark)
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench, broadcast_rows=rows).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (4, 3), (None, 5)}
    assert (got[1, 0].n_tokens, got[1, 0].first_token, got[1, 0].n_equal) == (20, 30, 20)
    assert got[4, 3].n_equal >= 0.8 * got[4, 3].n_tokens


def test_cleaned(spark):
    bench, docs = frames(spark)
    kept = decontam.cleaned(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 8, *range(100, 120)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.cleaned(docs, none).count() == docs.count()
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def overlap(text, item):
    """Whether along any diagonal all tokens, or a stretch between two equal ones, are enough and 0.8 equal."""
    least = min(12, len(item))
    for d in range(1 - len(item), len(text)):
        side = [text[d + j] == item[j] for j in range(max(0, -d), min(len(item), len(text) - d))]
        if len(side) >= least and sum(side) * 5 >= len(side) * 4:
            return True
        for i in range(len(side)):
            for j in range(i + least, len(side) + 1):
                if side[i] and side[j - 1] and sum(side[i:j]) * 5 >= (j - i) * 4:
                    return True
    return False


@pytest.mark.parametrize("rows", [200_000, 0])
def test_random_substitutions(spark, rows):
    random = np.random.default_rng(11)
    items = [(m, prose(random, m).split()) for m in range(9, 31)] + [(60, prose(random, 60).split())]
    docs = [(1, items[6][1][:3] + ["x"] + items[6][1][4:]), (2, [w if i not in (3, 6) else "x" for i, w in enumerate(items[1][1])])]
    for m, words in items:
        for k in range(m // 5 + 3):
            for _ in range(4):
                at = set(random.choice(m, k, replace=False))
                copy = [f"x{i}" if i in at else w for i, w in enumerate(words)]
                start = random.integers(0, 8) if k % 2 else 0
                docs.append((len(docs) + 1, [*prose(random, 6).split(), *copy[start : start + random.integers(10, 40)], *prose(random, random.integers(1, 6)).split()]))
    expected = {(d, m) for d, text in docs for m, words in items if overlap(text, words)}
    assert {(1, 15), (2, 10)} <= expected and len(expected) < len(docs) - 40
    frame = lambda pairs, n: spark.createDataFrame([(k, " ".join(w)) for k, w in pairs], f"{n} long, text string")
    got = decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), broadcast_rows=rows).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(r.n_equal * 5 >= r.n_tokens * 4 and r.last_token - r.first_token + 1 == r.n_tokens for r in got)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_short_items(spark, rows):
    random = np.random.default_rng(15)
    items = [(m, prose(random, m)) for m in range(1, 9)]
    docs = [(10 * m + k, text) for m, item in items for k, text in enumerate([item.upper() + ".", f"{prose(random, 4)}, {item} {prose(random, 3)}", " ".join(item.split()[:-1] + ["x"])])]
    frame = lambda pairs, n: spark.createDataFrame(pairs, f"{n} long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.first_token) for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), broadcast_rows=rows).collect()}
    assert got == {(10 * m, m): (m, 0) for m, _ in items} | {(10 * m + 1, m): (m, 4) for m in range(5, 9)}


# repeated passages


def test_repeats(spark):
    random = np.random.default_rng(6)
    passage = ". ".join(prose(random, 9).capitalize() for _ in range(7)) + "."
    rows = [(k, ". ".join(prose(random, 8).capitalize() for _ in range(5)) + ".") for k in range(10)]
    rows += [(20, f"{prose(random, 12)} {passage} {prose(random, 6)}"), (21, f"Start. {passage}\nEnd"), (22, passage.upper() + "\n" + passage.replace(" ", "\n")), (23, None), (24, ""), (25, "Short line.\nShort line."), (26, "Short line."), (21, f"Start. {passage}\nEnd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS digest", "2 AS key")
    got = substring.repeats(docs).collect()
    assert {r.doc_id for r in got} == {21, 22} and {r.first_doc_id for r in got} == {20}
    assert len([r for r in got if r.doc_id == 21]) == 1 and max(r.n_words for r in got if r.doc_id == 22) > 100
    text = dict(rows)
    for r in got:
        assert len(set(text[r.doc_id][r.start : r.end].lower().split()) & set(passage.lower().split())) > 30
    assert substring.repeats(docs.limit(0)).count() == 0


def test_repeats_of_rows_without_id_with_one_id_and_within_a_text(spark):
    random = np.random.default_rng(16)
    passage, other = prose(random, 40), prose(random, 60)
    rows = lambda pairs: spark.createDataFrame(pairs, "doc_id long, text string")
    assert [(r.doc_id, r.n_words > 24, r.first_doc_id) for r in substring.repeats(rows([(None, passage)] * 3)).collect()] == [(None, True, None)] * 2
    assert [(r.doc_id, r.first_doc_id) for r in substring.repeats(rows([(None, passage), (5, passage)])).collect()] == [(None, 5)]
    twice = rows([(5, passage), (5, f"{other} {passage} {other}")])
    found = substring.repeats(twice).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(5, 5)} and 2 >= len(found) >= 1
    assert substring.repeats(rows([(5, f"{other} x {other}")])).count() == 1
    assert substring.repeats(rows([(5, f"{other} x {other}")]), within=False).count() == 0
    (one,) = substring.repeats(rows([(5, "tick " * 200)])).collect()  # what overlaps the first occurrence stays
    assert one.start >= 25 * 5 and one.end == 200 * 5 - 1


def test_repeated_lines_paragraphs_and_passages_go_whole(spark):
    """Every later line, paragraph and passage of 51 words goes to its last word, and nothing but what was there before."""
    random = np.random.default_rng(18)
    lines = [prose(random, n) for n in (1, 3, 4, 5, 6, 9, 24)]
    blocks = ["\n".join(prose(random, n) for n in sizes) for sizes in ((3, 3), (2, 4, 2), (7, 1, 8))]
    passages = [prose(random, n) for n in (51, 52, 55, 64, 90)]
    rows = []
    for k in range(80):
        parts = [prose(random, random.integers(6, 30)) for _ in range(random.integers(1, 6))]
        for _ in range(random.integers(0, 3)):
            parts.insert(random.integers(0, len(parts) + 1), random.choice(lines).upper() + "!")
        if random.random() < 0.4:
            parts.insert(random.integers(0, len(parts) + 1), "\n" + random.choice(blocks) + "\n \n")
        at = random.integers(0, len(parts))
        if random.random() < 0.5:
            parts[at] = f"{prose(random, random.integers(0, 9))} a{k} {random.choice(passages)} z{k} {prose(random, random.integers(0, 9))}"
        rows.append((k, "\n".join(parts)))
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    places = {k: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)] for k, t in rows}
    reported = {(r.doc_id, i) for r in got for i, (a, b, _) in enumerate(places[r.doc_id]) if r.start <= a and b <= r.end}
    seen, wanted = set(), set()
    for k, text in rows:
        words = [w for _, _, w in places[k]]
        for stretch in [*re.finditer(r"[^\n]+", text), *re.finditer(r"(?:(?!\n\s*\n)[\s\S])+", text)]:
            inside = [i for i, (a, b, _) in enumerate(places[k]) if stretch.start() <= a and b <= stretch.end()]
            unit = (stretch.re.pattern, *(words[i] for i in inside))
            if len(inside) >= 5:
                if unit in seen:
                    wanted |= {(k, i) for i in inside}
                seen.add(unit)
        for i in range(len(words) - 50):
            if ("passage", *words[i : i + 51]) in seen:
                wanted |= {(k, j) for j in range(i, i + 51)}
        seen |= {("passage", *words[i : i + 51]) for i in range(len(words) - 50)}
    assert len(wanted) > 800 and wanted <= reported
    fives = {}
    for k, found in places.items():
        for i in range(len(found) - 4):
            fives.setdefault(tuple(w for _, _, w in found[i : i + 5]), []).append((k, i))
    again = {(k, i + j) for at in fives.values() for k, i in at[1:] for j in range(5)}
    assert reported <= again
    assert all(r.n_words == sum(r.start <= a and b <= r.end for a, b, _ in places[r.doc_id]) >= 5 for r in got)
    none = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), lines=0).collect()
    assert all(r.n_words >= 25 for r in none)


def test_repeats_equal_brute_force(spark):
    random = np.random.default_rng(17)
    passages = [prose(random, n) for n in (26, 51, 51, 60, 120)]
    rows = []
    for k in range(60):
        parts = [prose(random, random.integers(0, 40)) for _ in range(3)]
        for p in random.choice(passages, random.integers(0, 3)):
            words = p.split()
            parts.insert(random.integers(0, 3), random.choice([" ", "\n", ". "]).join(w.capitalize() if random.random() < 0.2 else w for w in words))
        rows.append((k, random.choice([" ", "\n", " - "]).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(docs).collect()
    places = {k: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)] for k, t in rows}
    many = {}
    for k, found in places.items():
        for n in (25, 51):
            for i in range(len(found) - n + 1):
                many.setdefault((n, *(w for _, _, w in found[i : i + n])), []).append((k, i))
    reported = {(r.doc_id, i) for r in got for i, (a, b, _) in enumerate(places[r.doc_id]) if r.start <= a and b <= r.end}
    repeated = {(k, i + j) for w, at in many.items() if w[0] == 25 and len(at) > 1 for k, i in at for j in range(25)}
    assert reported <= repeated
    wanted = 0
    for w, at in many.items():
        for k, i in at[1:] if w[0] == 51 else ():
            if k != at[0][0] or i >= at[0][1] + 51:
                wanted += 1
                assert sum((k, i + j) in reported for j in range(51)) >= 25
    assert wanted > 100
    assert all(r.n_words == sum(r.start <= a and b <= r.end for a, b, _ in places[r.doc_id]) for r in got)


@pytest.mark.parametrize("text", ["One two_three\nfour İx five. Ünï 12\u0301 ß\U00010400", "a" * 50, "", " ?\n", "x y " * 700_000])
def test_words_keep_offsets(text):
    _, start, end = substring.words(text)
    low = text.lower() if len(text.lower()) == len(text) else text
    assert list(zip(start.tolist(), end.tolist())) == [m.span() for m in re.finditer(r"[^\W_]+", low)]


# languages


def test_languages(spark):
    random = np.random.default_rng(7)
    kinds = {"aa": [f"{x}ong{y}" for x in "bcdf" for y in "aeiou"], "bb": [f"sch{x}{y}" for x in "aeiou" for y in "klmn"]}
    make = lambda lang, n: " ".join(random.choice(kinds[lang], n))
    train = spark.createDataFrame([(k, make(x, 80), x) for k in range(60) for x in kinds] + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    content = langid.dictionaries(train)
    assert set(content) == {"aa", "bb"} and max(map(len, content.values())) <= langid.DICTIONARY
    rows = [(k, make(x, 40), x) for k in range(30) for x in kinds] + [(200, make("bb", 40_000), "bb"), (201, None, "und"), (202, "", "und"), (203, "123 !!", "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' AS score")
    got = langid.identified(docs, content, docs.columns).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if not r.accepted} == {201, 202, 203}
    assert {r.lang_pred for r in langid.identified(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.identified(docs.limit(0), content, ["doc_id"]).count() == 0


def test_languages_of_repeated_rows_and_ties(spark):
    random = np.random.default_rng(19)
    make = lambda: " ".join(random.choice(WORDS, 60))
    texts = [make() for _ in range(30)]
    train = spark.createDataFrame([(k, t, x) for k, t in enumerate(texts) for x in ("aa", "bb")], "doc_id long, text string, lang string")
    content = langid.dictionaries(train)
    rows = [(1, make(), None), (1, make(), None), (2, make(), None)] + [(3, texts[0], None)] * 3
    got = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), content, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 3, 3] and len({(r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 1
    assert all(r.lang_pred in ("aa", "bb") and not r.accepted for r in got)  # both languages have the same texts


# quality


def test_quality(spark):
    random = np.random.default_rng(8)
    rows = []
    for k in range(400):
        good = k % 3 > 0
        text = prose(random, 60) if good else " ".join(w + "%%%" for w in random.choice(WORDS[:20], 40))
        rows.append((k, text, int(good)))
    labelled = spark.createDataFrame(rows + [(900, None, 1), (901, "", 0), (902, "x", None)], "doc_id long, text string, label int")
    model = quality.fitted(labelled.where("doc_id % 4 > 0"))
    got = quality.scored(labelled.selectExpr("*", "7 AS score"), ["doc_id", "label", "score"], model).where("doc_id < 900").collect()
    assert np.mean([(r.score > 0.5) == (r.label == 1) for r in got if r.doc_id % 4 == 0]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    again = quality.scored(labelled, ["doc_id"], quality.fitted(labelled.where("doc_id % 4 > 0"))).where("doc_id < 900").collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}
    none = quality.scored(labelled, ["doc_id"], quality.fitted(labelled.where("label = 1"))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scored(labelled.limit(0), ["doc_id"], model).count() == 0


def test_quality_of_repeated_rows_and_a_long_text(spark):
    random = np.random.default_rng(20)
    rows = [(k, prose(random, 60) if k % 3 else " ".join(w + "%%%" for w in random.choice(WORDS[:20], 40)), int(k % 3 > 0)) for k in range(300)]
    model = quality.fitted(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    good, bad = prose(random, 200_000), " ".join(w + "%%%" for w in random.choice(WORDS[:20], 100_000))
    odd = [(1, good), (2, bad), (3, rows[1][1]), (3, rows[1][1]), (None, rows[1][1]), (4, "x" * 1_000_000)]
    got = quality.scored(spark.createDataFrame(odd, "doc_id long, text string"), ["doc_id"], model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and score[1] > 0.5 > score[2] and len({r.score for r in got if r.doc_id in (3, None)}) == 1 and 0 <= score[4] <= 1


def test_capitals_of_the_whole_text_count():
    pooler = quality.Pooler([], None)
    for text in ("aBcDefgh", "Xbcdefg" * 40, "xBCDEFG" * 40, "É und Ω, " * 9 + "ÀÀ"):
        assert pooler.vector(text)[-1] == np.float32(sum(map(str.isupper, text)) / len(text))
        assert abs(pooler.vector(f" {text}")[-1] - pooler.vector(text)[-1]) <= 1 / len(text)


def test_quality_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(400)] + [(1, "again"), (None, "n"), (2, None)], "doc_id long, text string").selectExpr("*", "0 AS label")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, 0), (999, 1), (3, None), (None, 1)], "doc_id long, label int")
    got = {r.doc_id: r for r in quality.sampled(docs, labels).collect()}
    digests = {r.doc_id: r.d for r in labels.where("doc_id < 200").selectExpr("doc_id", "xxhash64(cast(doc_id as string)) AS d").distinct().collect()}
    assert set(got) == set(sorted(digests, key=digests.get)[:50])
    assert all(r.label == k % 2 for k, r in got.items() if k != 1)
    assert quality.sampled(docs.limit(0), labels).count() == 0 and quality.sampled(docs, labels.limit(0)).count() == 0


# pages

PAGE = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='wrap'><div class='{c}'><h1>T {n}</h1><p>{t}<p>A &amp; b&nbsp;c<br>d <script>x</script></div><div class=sidebar>{s}</div></div><footer>f</footer>"


def test_pages_vote_by_host(spark):
    long = "some words of a real article, with enough of them. " * 5
    rows = [(k, f"https://Host.example/{k}", PAGE.format(c=f"post-{k}", n=k, t=long, s="side " * 10)) for k in range(5)]
    rows += [(10, "https://host.example/x", PAGE.format(c="post-10", n=10, t="tiny", s="side " * 10) + "<div class=other>" + "unrelated text here " * 30), (11, None, "<p>only <b>this"), (12, "u", None), (13, "u", ""), (14, "u", "no tags")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {r.page_id: r.text for r in html.extracted(pages, ["page_id", "text"]).collect()}
    assert got[0] == f"T 0\n\n{long.strip()}\n\nA & b c d"
    assert got[10] == "T 10\n\ntiny\n\nA & b c d"
    assert (got[11], got[12], got[13], got[14]) == ("only this", "", "", "no tags")
    assert html.extracted(pages.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>a<div class='comments'><article><p>said</p></article></div></article>", "T\n\na"),
        ("<body class='has-sidebar'><main><div id='cookie-notice'>c</div><p>x  y\n z</main>", "x y z"),
        ("<div class='layout sidebar-left'><main><p>body</main></div>", "body"),
        ("<article><p>1 &lt; 2 <!-- no --> &#233;<form>f</form><ul><li>a<li>b</ul></article>", "1 < 2 é\n\na\n\nb"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><table><tr><td>a<td>b</table><p style='display:none'>h</p><aside>s</aside></article>", "a\n\nb"),
        ("<article><p>a</p><p title=don't>b</p><p>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p><p title=\"it's\">b</p><p x='1' y=\"2>3\">c</p><p>d</article>", "a\n\nb\n\nc\n\nd"),
        ("<article><p>a<p title = \"never>b</p><p>c <i>d</i></article>", "a\n\nb\n\nc d"),
        ("<article><p>a</p><p>c <!--> d<!-- > --!> e<!-- <p>--> f</article>", "a\n\nc d e f"),
        ("<article><p>a</p><!-- never closed > b<p>c <!-- too > d</article>", "a\n\nb\n\nc d"),
        ("<article><p>a</p><div class='related-work'>r <a>l</a></div><div class='skip'>s</div><p class='notice-period'>n</p></article>", "a\n\nr l\n\ns\n\nn"),
        ("<article><div class='post-header'><h1>T</h1></div><header><h2>U</h2></header><p>a</p><header>h</header></article>", "T\n\nU\n\na"),
        ("<article><p>a</p><div class='related-posts'><a>x y z</a> of</div><div class='site-notice'>n</div><div id=ad-3>n</div><ul class=post-comments>c</ul></article>", "a"),
        ("<head><title>t</title><p>no body tag", "no body tag"),
        ("<form id=all><nav>n</nav><main><p>a<form>f</form></main></form>", "a"),
        ("<article><pre>x <span class='comment'># y</span></pre><p>a < b <textarea>c</p></article>", "x # y\n\na < b c"),
    ],
)
def test_page_parts(page, text):
    assert html.main_text(page, []) == text


def test_deep_and_odd_pages_take_linear_time():
    begun = time.perf_counter()
    for page in ("<div>x" * 16_000, "<b>" * 16_000 + "<div>x" * 16_000, "<h1>" * 8_000 + "<p>y" * 8_000, "<li>" * 20_000 + "</span>" * 20_000,
                 '<p a=">b" c="' * 8_000, "<!-- x " * 20_000, "<title>" * 10_000, "<article>" + "<p>word " * 100_000):
        html.main_text(page, [html.vote_of(page)[0]])
    assert time.perf_counter() - begun < 20
    assert html.main_text("<div>x" * 16_000, []).count("x") == 16_000


def plain_dom(page):
    """Brute force for well-formed pages: text of each block of the article, by the standard parser."""

    class Reader(HTMLParser):
        blocks, skip, inside = [""], 0, 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += tag in ("nav", "aside", "script", "form")
            if tag in html.BLOCK:
                self.blocks = [*self.blocks, ""]

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.skip -= tag in ("nav", "aside", "script", "form")
            if tag in html.BLOCK:
                self.blocks = [*self.blocks, ""]

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1] += data

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    return "\n\n".join(" ".join(b.split()) for b in reader.blocks if b.split())


def test_pages_equal_brute_force():
    random = np.random.default_rng(14)
    for _ in range(60):
        parts = []
        for _ in range(random.integers(1, 30)):
            text = f"{prose(random, random.integers(1, 9))} &amp; \n {random.choice(['<b>x</b>', '<i title=\"a>b\">y</i>', '&eacute;', '1 < 2', '<a href=/x>l</a>'])} z"
            kind = random.choice(["p", "li", "h2", "div", "blockquote", "nav", "aside", "script", "section"])
            parts.append(f"<{kind} class='c{random.integers(9)} k' data-x=\"it's\">{text if kind != 'script' else 'var a;'}</{kind}>")
        page = f"<!doctype html><html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article>{prose(random, 80)} {' '.join(parts)}</article><footer>f</footer></body></html>"
        assert html.main_text(page, []) == plain_dom(page)


def test_all_paths_can_be_kept(spark):
    rows = [(k, "http://h/", f"<article class='{c}'>{c} text of its own") for k, c in enumerate("abcdefgh")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [len(r.paths) for r in html.winners(pages, None, 0.0).collect()] == [8]
    assert [len(r.paths) for r in html.winners(pages, 2).collect()] == [2]
    assert sorted(r.text for r in html.extracted(pages, ["page_id"], None, 0.0).collect()) == [f"{c} text of its own" for c in "abcdefgh"]


# chat


def test_round_trip(spark):
    rows = [(1, 2, "assistant", "a \\ <| b"), (1, 0, "system", None), (1, 1, "us\ner", "<|im_end|>\n<|im_start|>x\\n"), (2, 0, "assistant", ""), (None, 0, None, "n"), (3, None, "user", "é" * 10), (3, 5, "assistant", "x" * 100_000), (3, 5, "assistant", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'p' AS piece")
    pieces = chat.formatted(frame)
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].formatted_chars == len("<|im_start|>assistant\n<|im_end|>\n")
    assert chat.read_back(chat.formatted(frame.limit(0))).count() == 0


def run(template, *turns):
    return "".join(t for t, _ in chat.compiled(template)({"role": r, "text": x} for r, x in turns) if t)


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_read_back_takes_rows_in_any_order(spark, kind):
    rows = [(c, t, r, f"{r} {t} says <|im_end|>") for c in range(4) for t, r in enumerate(["user", "assistant"] * 5)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = given.withColumn("conv_id", given["conv_id"].cast(kind))
    pieces = chat.formatted(frame)
    assert pieces.schema["conv_id"].dataType == frame.schema["conv_id"].dataType
    mixed = pieces.orderBy("piece").repartition(5)
    told = sorted(map(tuple, chat.read_back(pieces, in_order=True).collect()))
    assert sorted(map(tuple, chat.read_back(mixed).collect())) == told and len(told) == 4
    with pytest.raises(Exception, match="of a conversation in place"):
        chat.read_back(pieces.coalesce(1).sortWithinPartitions("conv_id", pieces["part"].desc()), in_order=True).collect()


def test_escapes_of_roles():
    assert run("{% for m in messages %}{{ m.role | trim | escape }};{{ 'a' + m.role | escape }}{% endfor %}", (" u\nv ", "")) == "u\\nv;a u\nv ".replace("a u\nv", "a u\\nv")


def test_templates():
    t = "{{ 'A' + 'b' | upper }}{% for m in messages %}{% if loop.first and m.role != 'user' %}!{% elif loop.last %}.{% else %},{% endif %}{{ loop.index }}{{ m.text | trim }}{% endfor %}"
    assert run(t, ("system", " x "), ("user", "y"), ("user", "z")) == "AB!1x,2y.3z"
    assert chat.folded(chat.parsed("a{% if 1 == 2 %}b{% else %}{{ 'c' }}{% endif %}d")) == [("text", "acd")]


@pytest.mark.parametrize("bad", ["{{ m.text }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ open('x') }}", "{{ 'a' | eval }}", "{% for m in messages %}", "{% import os %}", "{{ 1 + }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compiled.__wrapped__(bad)
