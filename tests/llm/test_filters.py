"""HTML extraction, toxicity, quality rules and language ID."""

import math
import random
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from conftest import DATA
from .helpers import awkward, docs, labels

from nestquery.llm import html_text as ht
from nestquery.llm import langid as li
from nestquery.llm import quality as ql
from nestquery.llm import text as tx
from nestquery.llm import toxicity as to
from nestquery.llm.tables import table

LARGE = DATA.replace("sf0.001", "sf0.01")

PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<ul class="nav"><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/b">Shop</a></li></ul>
<div id="main"><h1>Heading</h1><p>The first long paragraph of the article has many words &amp; no links at all, so that it is dense.</p>
<p>The second one is as long as the first, and mentions <a href="/x">one thing</a> on the way to its distant end.</p></div>
<div class="foot"><a href="/1">Terms</a> <a href="/2">Privacy</a> <a href="/3">Jobs</a></div><script>var x = "<p>no</p>";</script></body></html>"""


class Brute(HTMLParser):
    """The tree of a well-formed page, by the standard library."""

    def __init__(self, page):
        super().__init__()
        self.root = self.node = {"tag": "body", "up": None, "kids": [], "chars": 0}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        node = {"tag": tag, "up": self.node, "kids": [], "chars": 0}
        self.node["kids"].append(node)
        if tag not in ht.VOID:
            self.node = node

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self.node = self.node["up"]

    def handle_data(self, data):
        at = self.node
        while at:
            if at["tag"] in ht.RAW:
                return
            at = at["up"]
        self.node["chars"] += sum(map(len, data.split()))


def measure(v):
    c, t, lc, lt = v["chars"], 0, 0, 0
    for k in v["kids"]:
        kc, kt, klc, klt = measure(k)
        c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (k["tag"] == "a")
    v["all"] = (c, t, c, t) if v["tag"] == "a" else (c, t, lc, lt)
    return v["all"]


def brute_densities(page):
    root = Brute(page).root
    measure(root)
    ratio, out = root["all"][2] / max(1, root["all"][0]), []

    def density(v):
        c, t, lc, lt = v["all"]
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(1, c - lc) * lc + ratio * c + math.e))
        return c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt), base) if c / max(1, lc) * max(1, t) / max(1, lt) > 0 else 0.0

    def visit(v):
        out.append((round(density(v), 6), round(sum(density(k) for k in v["kids"]), 6)))
        for k in v["kids"]:
            visit(k)

    visit(root)
    return out


def test_densities():
    tree = ht.Tree(PAGE)
    density, total = ht.densities(tree)
    assert [(round(d, 6), round(s, 6)) for d, s in zip(density, total)] == brute_densities(PAGE)


def test_content():
    text, top, least = ht.extract(PAGE)
    assert "first long paragraph" in text and "one thing" in text and "words & no" in text
    assert "Shop" not in text and "Privacy" not in text and "no</p>" not in text and "p{}" not in text
    assert top > 0 and least > 0


@pytest.mark.parametrize("page, want", [("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<div><b>x</div></b>y", "x\ny"), ("a < b", "a < b"), ("<p", ""), ("<!-- x", ""), ("<script>1", ""), ("&lt;p&gt;", "<p>"), ("<p>" * 5000 + "deep", "deep"), ("</p></div>", "")])
def test_awkward_html(page, want):
    text = ht.extract(page)[0]
    assert text == want


def test_extraction_of_a_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>some text</p>", "x"), (4, "u", "<p>" + "word " * 100_000, "x")]
    df = ht.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = {(r.page_id, r.url): r for r in df.collect()}
    assert df.count() == 6 and got[(2, None)].text is None and got[(3, "u")].text == "" and got[(4, "u")].n_chars == 499_999
    assert got[(None, "u")].text == "some text"
    assert ht.extract_pages(table(spark, DATA, "pages").limit(0)).collect() == []
    whole = table(spark, DATA, "pages")
    assert ht.extract_pages(whole).count() == whole.count()
    assert ht.extract_pages(whole).filter("n_chars > 0").count() > 0.9 * whole.count()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_all_distances():
    config = to.ToxicityConfig()
    terms = ["idiot", "idiotic", "scum", "disgusting", "worthless", "imbecile", "abc*"]
    automaton = to.Automaton(terms, config)
    rng = random.Random(8)
    words = set()
    for t in terms:
        t = t.rstrip("*")
        words.add(t)
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice("abcdegiotsuw")]])
            words.add("".join(w))
    for w in words - {""}:
        hits = automaton.hits(w)
        want = set()
        for t in terms:
            if t.endswith("*"):
                if w.startswith(t[:-1]):
                    want.add(t)
            elif w[0] == t[0] and distance(w, t) <= (len(t) >= config.one_edit) + (len(t) >= config.two_edits):
                want.add(t)
        assert bool(hits) == bool(want), (w, want, hits)
        if hits:
            assert terms[hits[0][2]] in want


def test_context():
    config = to.ToxicityConfig()
    score = lambda t: sum(to.weight(t, a, b, e, config) for a, b, _, e in to.Automaton(list(config.lexicon), config).hits(t))
    assert score("you are an idiot") >= config.threshold > score('he called them "an idiot" in the play')
    assert score("they wrote that idiot is a greek word") < config.threshold and score("she is not an idiot") < config.threshold
    assert score("you are an idi0t and a m0ron") >= config.threshold and score("you worthles idioot") >= config.threshold
    assert score("the village lies by a river") == 0


def test_toxicity_of_held_out_documents(spark):
    config = to.ToxicityConfig(fit_rows=150)
    some = DATA.replace("sf0.001", "sf0.1")
    d, lab = table(spark, some, "documents"), table(spark, some, "labels")
    lexicon_rows = {r._id for k in (0, 1) for r in lab.filter(f"toxic = {k}").selectExpr("doc_id as _id").distinct().orderBy(to.F.xxhash64("_id"), "_id").limit(config.fit_rows).collect()}
    truth = {r.doc_id: r.toxic for r in lab.collect()}
    got = {r.doc_id: r.toxic for r in to.toxicity(d, lab, config).collect()}
    test = [i for i in truth if i not in lexicon_rows]
    hit = [got[i] for i in test if truth[i] == 1]
    false = [got[i] for i in test if truth[i] == 0]
    assert len(hit) >= 50 and len(false) >= 500 and np.mean(false) <= 0.02 and np.mean(hit) >= 0.9


def test_toxicity_of_awkward_rows(spark):
    rows = awkward("you stupid idiot " + "calm words here " * 5_000)
    got = sorted(((r.doc_id, r.toxic, r.n_hits) for r in to.toxicity(docs(spark, rows), labels(spark)).collect()), key=str)
    assert len(got) == len(rows) and (5, True, 2) in got and (2, False, 0) in got
    assert to.toxicity(docs(spark, []), labels(spark, [(1, 1, 1), (None, None, None), (1, 1, 1)])).collect() == []


def test_distances():
    rng = np.random.default_rng(2)
    for _ in range(50):
        p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
        m = (p + q) / 2
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)
        assert abs(ql.js_distance(p, q) - math.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-9
    assert ql.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and ql.js_distance(np.array([1.0, 0]), np.array([1.0, 0])) == 0


def test_quality_of_held_out_documents(spark):
    config = ql.QualityConfig(fit_rows=120)
    d, lab = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    fitted = {r._id for r in lab.filter("quality = 1").selectExpr("doc_id as _id").distinct().orderBy(ql.F.xxhash64("_id"), "_id").limit(config.fit_rows).collect()}
    rows = ql.quality_scores(d, lab, config).collect()
    keep, short = {r.doc_id: r.keep for r in rows}, {r.doc_id for r in rows if r.verdict == "short"}
    truth = {r.doc_id: r.quality for r in lab.collect() if r.doc_id not in fitted and r.doc_id not in short}
    good, bad = [keep[i] for i in truth if truth[i] == 1], [keep[i] for i in truth if truth[i] == 0]
    assert np.mean(good) >= 0.97 and len(bad) >= 10 and np.mean(bad) <= 0.1
    assert {r.doc_id for r in ql.keep_quality(d, lab, config).collect()} == {i for i, k in keep.items() if k}


def test_quality_of_awkward_rows(spark):
    good = [(100 + i, "The small house stands on the hill, and the river runs under the old bridge to the sea. " * 3) for i in range(20)]
    rows = good + awkward() + [(50, "@@@@ #### 1234 !!!! " * 50), (51, "zxqv wkjh pqrs " * 80)]
    d, lab = docs(spark, rows), labels(spark, [(100 + i, 1, 0) for i in range(20)] + [(None, 1, 0), (999, 1, 0), (100, 1, 0)])
    got = {r.doc_id: r.verdict for r in ql.quality_scores(d, lab).collect()}
    assert got[100] == "pass" and got[2] == got[3] == got[4] == "empty" and got[8] == "short" and got[50] == "diverges"
    assert got[51] == "diverges"
    kept = ql.keep_quality(d, lab)
    assert kept.columns == d.columns and {100, 8, 1} <= {r.doc_id for r in kept.collect()}
    assert {r.verdict for r in ql.quality_scores(docs(spark, good), labels(spark)).collect()} == {"unjudged"}
    assert ql.quality_scores(docs(spark, []), lab).collect() == [] and ql.keep_quality(docs(spark, []), lab).collect() == []


def test_languages_of_documents_not_trained_on(spark):
    d = table(spark, LARGE, "documents")
    held = {r.text: r.lang for r in d.filter("doc_id % 2 = 1 AND n_chars >= 60").collect()}
    fitted = {r.text for r in d.filter("doc_id % 2 = 0").collect()}
    texts = [t for t in held if t not in fitted]
    config = li.LangIdConfig()
    names, _, ok = li.Classifier(li.train(d.filter("doc_id % 2 = 0"), config), config).classify(pa.array(texts))
    assert len(texts) > 200 and np.mean(ok) >= 0.9 and np.mean([n == held[t] for n, t, k in zip(names, texts, ok) if k]) >= 0.98


def test_languages_of_the_table(spark):
    d = table(spark, LARGE, "documents")
    known = {r.doc_id: (r.lang, r.n_chars) for r in d.collect()}
    got = li.language_scores(d).collect()
    assert len(got) == len(known)
    told = [(r.language, known[r.doc_id][0]) for r in got if r.language is not None and known[r.doc_id][1] >= 60]
    assert np.mean([a == b for a, b in told]) >= 0.98 and len(told) >= 0.9 * sum(n >= 60 for _, n in known.values())


def test_sizes_against_single_compressions(spark):
    config = li.LangIdConfig()
    dictionaries = {"a": b"the house on the hill and the river " * 40, "b": b"das haus auf dem berg und der fluss " * 40}
    texts = ["the river on the hill", "der berg und das haus", "", None, "x" * 10_000, "the das and und"]
    c = li.Classifier(dictionaries, config)
    want = []
    for t in texts:
        row = []
        for name in ("a", "b"):
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z = zstandard.ZstdCompressor(level=config.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            data = (t or "").encode()
            row.append(sum(len(z.compress(data[i : i + config.block])) for i in range(0, len(data), config.block)))
        want.append(row)
    assert c.sizes(pa.array(texts)).tolist() == want
    names, margin, ok = c.classify(pa.array(texts))
    assert names[:4] == ["a", "b", None, None] and ok[:4].tolist() == [True, True, False, False] and not ok[4]


def test_languages_of_awkward_rows(spark):
    rows = awkward() + [(60 + i, "the house on the hill and the river that runs down to the old town " * 4, "en") for i in range(5)] + [(70 + i, "das alte haus auf dem berg und der fluss der in die kleine stadt hinunter geht " * 4, "de") for i in range(5)] + [(80, "whatever it is", None)]
    d = docs(spark, rows)
    got = {r.doc_id: r.language for r in li.language_scores(d).collect()}
    assert got[60] == "en" and got[70] == "de" and got[2] is None and got[3] is None
    kept = li.keep_identified(d)
    assert kept.columns == d.columns and {60, 70} <= {r.doc_id for r in kept.collect()}
    assert li.language_scores(docs(spark, [])).collect() == [] and li.keep_identified(docs(spark, [(1, "text", None)])).collect() == []


def test_words():
    texts = ["A b-c's ÜBER", "", "  ", "x_1 2", "日本 語"]
    got = tx.hash_words(texts)
    want = [["a", "b", "c", "s", "über"], [], [], ["x_1", "2"], ["日", "本", "語"]]
    seen = {}
    for h, w in zip(got, want):
        assert len(h) == len(w)
        for x, y in zip(h.tolist(), w):
            assert seen.setdefault(y, x) == x
    assert len(set(seen.values())) == len(seen)


def test_swapped_letters():
    config = to.ToxicityConfig()
    terms = ["idiot", "moron", "scum", "worthless", "pathetic"]
    automaton = to.Automaton(terms, config)
    for t in terms:
        for i in range(1, len(t) - 1):
            w = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
            hits = automaton.hits(w)
            assert [(terms[k], e) for *_, k, e in hits] == ([(t, int(w != t))] if len(t) >= config.one_edit or w == t else []), w
    assert automaton.hits("wrothles") and not automaton.hits("idoti x") and not automaton.hits("wrohtles")


def test_misspelled_learned_words(spark):
    """A word that only the sample has is found misspelled; what is rare or quoted in clean rows stays a hit."""
    toxic = [(i, f"wort{i} und dann dummkopf{'' if i % 2 else ' sagte'} a{i} dummkopf b{i}") for i in range(60)]
    plain = [(100 + i, f"ganz c{i} normale d{i} worte morons" + (" idoit" if i == 0 else "") + (' "morron" ' if i < 9 else "") + f" e{i} dumkopf" * (i == 1)) for i in range(60)]
    lab = labels(spark, [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in plain])
    d = docs(spark, toxic + plain + [(900, "so ein dummkofp oder du dumkopf"), (901, "an idoit"), (902, "a morron")])
    lexicon = to.learn(d, lab)
    assert "dummkopf" in lexicon.learned and not lexicon.exact & {"dummkopf", "idiot", "moron"} and not lexicon.ordinary
    got = {r.doc_id: (r.n_hits, r.terms) for r in to.toxicity(d, lab).filter("doc_id >= 900").collect()}
    assert got == {900: (2, ["dummkopf"]), 901: (1, ["idiot"]), 902: (1, ["moron"])}


def test_ordinary_words(spark):
    plain = [(i, f"c{i} moran d{i} stands") for i in range(20)]
    lexicon = to.learn(docs(spark, plain), labels(spark, [(i, 1, 0) for i, _ in plain]))
    assert lexicon.ordinary == {"moran"}


def test_one_misspelled_insult(spark):
    rows = [(1, "what an idoit"), (2, "a wrothles fellow"), (3, 'a "wrothles" fellow'), (4, "not an idoit"), (5, "they wrote idoit there"), (6, "an idiot")]
    got = {r.doc_id: r.toxic for r in to.toxicity(docs(spark, rows), labels(spark)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_learned_hits_in_a_long_document(spark):
    config = to.ToxicityConfig()
    for n in (300, 3_000, 100_000):  # ten hits within 100 words, at the start, in the middle and at the end
        for first in (0, n // 2, n - 100):
            assert to.beyond_chance([first + 10 * i for i in range(10)], [1.0] * 10, n, config) >= config.threshold, (n, first)
        assert to.beyond_chance(list(range(0, n, 300)), [1.0] * len(range(0, n, 300)), n, config) < config.threshold  # no more than chance
    assert to.beyond_chance([], [], 100, config) == 0 and to.beyond_chance([0], [1.0], 1, config) >= config.threshold
    toxic = [(i, f"a{i} dummkopf b{i} dummkopf c{i}") for i in range(60)]
    plain = [(100 + i, f"ganz c{i} normale d{i} worte e{i}") for i in range(60)]
    calm = "schoene wiesen " * 2_500
    passage = " ".join(f"x{i} dummkopf" for i in range(10))
    d = docs(spark, toxic + plain + [(900, passage), (901, f"{calm}{passage} {calm}"), (902, calm), (903, f"{calm} dummkopf {calm}")])
    lab = labels(spark, [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in plain])
    got = {r.doc_id: r.toxic for r in to.toxicity(d, lab).filter("doc_id >= 900").collect()}
    assert got == {900: True, 901: True, 902: False, 903: False}


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 60])
@pytest.mark.parametrize("tag", ["noscript", "template", "svg"])
def test_no_text_at_any_depth(depth, tag):
    page = "<div>" * depth + f"<p>shown</p><{tag}><b>hidden</b></{tag}><p>after</p>" + "</div>" * depth + f"<{tag}><p>hidden</{tag}>end"
    assert [t for _, t in ht.Tree(page).texts] == ["shown", "after", "end"]


def test_training_texts_are_distinct(spark):
    text = lambda i: f"the house {i} on the hill and the river {i} " * 8
    rows = [(i, text(i), "en") for i in range(40)]
    copied = [(1000 + 100 * i + j, text(i), "en") for i in range(40) for j in range(30)]
    config = li.LangIdConfig()
    assert li.train(docs(spark, rows + copied), config) == li.train(docs(spark, rows), config)
    assert li.train(docs(spark, rows + copied), config)["en"].count(b"house 39 on") == 8


def brute_content(tree):
    """Content, greatest density sum and threshold of a page by plain recursion."""
    kids = [[] for _ in tree.tag]
    for v, p in enumerate(tree.parent):
        if p >= 0:
            kids[p].append(v)
    own = [0] * len(kids)
    for v, s in tree.texts:
        own[v] += len("".join(s.split()))

    def sizes(v):
        c, t, lc, lt = own[v], 0, 0, 0
        for k in kids[v]:
            kc, kt, klc, klt = sizes(k)
            c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (tree.tag[k] == "a")
        return (c, t, c, t) if tree.tag[v] == "a" else (c, t, lc, lt)

    body = sizes(0)
    ratio = body[2] / max(1, body[0])

    def density(v):
        c, t, lc, lt = sizes(v)
        value = c / max(1, lc) * max(1, t) / max(1, lt)
        return c / max(1, t) * math.log(value, max(math.e, math.log(c / max(1, c - lc) * lc + ratio * c + math.e))) if value > 0 else 0.0

    every = [density(v) for v in range(len(kids))]
    total = [sum(every[k] for k in ks) for ks in kids]
    if not any(every):
        return set(), 0.0, 0.0
    below = lambda v: [v] + [x for k in kids[v] for x in below(k)]
    best = lambda v: max(below(v), key=lambda x: (round(total[x], 9), -x))
    path, v = [], best(0)
    while v >= 0:
        path.append(v)
        v = tree.parent[v]
    threshold = min(every[v] for v in path)
    marked = set()

    def go(v):
        if every[v] >= threshold - 1e-9:
            marked.update(below(best(v)))
            for k in kids[v]:
                go(k)

    go(0)
    return marked, max(total), threshold


def test_content_against_recursion(spark):
    seen = 0
    for r in table(spark, DATA, "pages").collect() + [type("R", (), {"html": PAGE})]:
        tree = ht.Tree(r.html)
        marked, top, least = brute_content(tree)
        text, got_top, got_least = ht.extract(r.html)
        words = " ".join(s for v, s in tree.texts if v in marked).split()
        assert "".join(text.split()) == "".join(words)
        assert math.isclose(top, got_top, abs_tol=1e-6) and math.isclose(least, got_least, abs_tol=1e-6)
        seen += bool(words)
    assert seen > 40


def test_well_formed_pages_against_the_other_parser():
    rng = random.Random(3)
    tags = ["div", "span", "b", "a", "noscript", "h1", "section"]

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["some words ", "x &amp; y ", "<br>", "<img src='a>b'>", "<!-- <b>no</b> -->"])
        tag = rng.choice(tags)
        return f"<{tag} class='k'>" + "".join(part(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag}>"

    for _ in range(60):
        page = "<html><body>" + "".join(part(5) for _ in range(4)) + "</body></html>"
        density, total = ht.densities(ht.Tree(page))
        assert [(round(d, 6), round(s, 6)) for d, s in zip(density, total)] == brute_densities(page)


@pytest.mark.parametrize("page", ["<b>x" * 60_000, "<b>x" * 30_000 + "</i>" * 30_000, "<b>x<p>y" * 30_000, "<div>x" * 40_000 + "</p>" * 20_000, '<a "' * 60_000, "<" * 100_000, "<td><b>" * 30_000])
def test_hostile_pages_take_linear_time(page):
    import time

    half = time.process_time()
    ht.extract(page[: len(page) // 4])
    half = time.process_time() - half
    whole = time.process_time()
    ht.extract(page)
    whole = time.process_time() - whole
    assert whole < 9 * half + 0.3  # a quadratic parser takes 16 times as long


def edits(a, b):
    """Edit distance where two neighbours that are swapped are one edit."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_toxicity_against_all_words_and_terms(spark):
    """Scores of every document by comparing every word with every term."""
    config = to.ToxicityConfig()
    d, lab = table(spark, DATA, "documents"), table(spark, LARGE, "labels")
    extra = [(10_000 + i, t) for i, t in enumerate(["you scum😀 idiot😀😀", "an idoit and a m0ron", "wrothles, \"worthles\" fellow", "not a clown; they said loser", "𝔞idiot 日本scum"])]
    d = d.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in extra], "doc_id long, text string, lang string"))
    lexicon = to.learn(d, lab)
    limit = lambda t: 0 if t.endswith("*") or t in lexicon.exact else (len(t) >= config.one_edit) + (len(t) >= config.two_edits)
    letters = {c for t in lexicon.terms for c in t.rstrip("*")}
    known = {}

    def match(word):
        if word not in known:
            w = "".join(to._LEET.get(c, c) if c not in letters else c for c in word)
            near = [(0, t) for t in lexicon.terms if t.endswith("*") and w.startswith(t[:-1])]
            near += [(e, t) for t in lexicon.terms if not t.endswith("*") and w[0] == t[0] and abs(len(w) - len(t)) <= 2 and (e := edits(w, t)) <= limit(t)]
            known[word] = min(near, default=None)
        return known[word]

    want = {}
    for r in d.collect():
        text, at, found = (r.text or "").lower(), 0, []
        while at < len(text):
            end = at
            while end < len(text) and text[end].isalnum():
                end += 1
            if end > at and (hit := match(text[at:end])) and not (hit[0] and text[at:end] in lexicon.ordinary):
                found.append((at, to.weight(text, at, end, hit[0], config), hit[1]))
            at = end + 1
        score = sum(w for _, w, t in found if t not in lexicon.learned)
        learned = [(text.count(" ", 0, a), min(1.0, w)) for a, w, t in found if t in lexicon.learned]
        score += to.beyond_chance([a for a, _ in learned], [w for _, w in learned], text.count(" ") + 1, config)
        want[r.doc_id] = (round(score, 5), len(found), sorted({t for *_, t in found}), round(score, 6) >= config.threshold)
    got = {r.doc_id: (round(r.score, 5), r.n_hits, r.terms, r.toxic) for r in to.toxicity(d, lab).collect()}
    assert got == want
    assert sum(n > 0 for _, n, *_ in want.values()) >= 8 and got[10_000][3] and got[10_000][1] == 2


def test_quality_against_plain_counts(spark):
    """References and verdicts by counting characters and words one by one."""
    import regex

    config = ql.QualityConfig(fit_rows=150)
    d, lab = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    refs = ql.train(d, lab, config)
    words_of = lambda t: regex.findall(rf"[{tx.SOLID}]|(?:_|[\p{{L}}\p{{M}}\p{{N}}--[{tx.SOLID}]])+", t.lower(), flags=regex.V1)

    def classes(t):
        out = [0] * len(ql.CLASSES)
        for c in t:
            out[7 if ord(c) > 127 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t" else 4 if c in "\r\n" else 5 if c in ".,;:?'\"()-" else 6] += 1
        return np.array(out)

    fitted = [r._id for r in lab.filter("quality = 1").selectExpr("doc_id as _id").distinct().orderBy(ql.F.xxhash64("_id"), "_id").limit(config.fit_rows).collect()]
    rows = d.collect()
    chars, counts = {}, {}
    for r in rows:
        if r.doc_id in fitted:
            chars[r.lang] = chars.get(r.lang, 0) + classes(r.text)
            for w in words_of(r.text):
                counts.setdefault(r.lang, {}).setdefault(w, 0)
                counts[r.lang][w] += 1
    assert list(refs.languages) == sorted(chars)
    assert all(np.allclose(refs.chars[i], chars[k] / chars[k].sum()) for i, k in enumerate(refs.languages))
    least = {k: sorted(c.values())[-config.common] for k, c in counts.items()}
    spelled = {int(tx.hash_words([w])[0][0]): w for c in counts.values() for w in c if any(c.get(w, 0) >= least[k] for k, c in counts.items())}
    common = [spelled[int(h)] for h in refs.words]
    for i, k in enumerate(refs.languages):
        total = sum(counts[k].values())
        some = refs.shares[i, :-1] > 0
        assert some.sum() == config.common and all(counts[k][common[j]] >= least[k] and math.isclose(refs.shares[i, j], counts[k][common[j]] / total) for j in np.flatnonzero(some))

    def verdict(r):
        w, c = words_of(r.text), classes(r.text)
        n = c.sum()
        if not w:
            return "empty"
        if n < config.min_chars or (len(w) < config.min_words and n < config.min_words * config.long_word):
            return "short"
        h = np.array([w.count(x) for x in common])
        h = np.append(h, len(w) - h.sum()) / len(w)
        for i in range(len(refs.languages)):
            if ql.js_distance(c / n, refs.chars[i]) <= config.max_char_distance + config.char_noise / math.sqrt(n) and ql.js_distance(h, refs.shares[i]) <= config.max_word_distance + config.word_noise / math.sqrt(len(w)):
                return "pass"
        return "diverges"

    got = {r.doc_id: r.verdict for r in ql.quality_scores(d, lab, config).collect()}
    assert got == {r.doc_id: verdict(r) for r in rows} and set(got.values()) >= {"pass", "diverges", "short"}


def test_quality_of_languages_without_references(spark):
    good = [(100 + i, "The small house stands on the hill, and the river runs under the old bridge to the sea. " * 3, "en") for i in range(20)]
    finnish = "Pieni talo seisoo mäellä, ja joki juoksee vanhan sillan alitse kohti merta, jossa laivat odottavat tuulta. " * 4
    blob = "".join(random.Random(4).choice("ABCDEFabcdef0123456789+/") for _ in range(3000))
    rows = good + [(1, finnish, "fi"), (2, finnish, None), (3, finnish, "en"), (4, blob, "en"), (5, "語" * 300, "ja"), (6, "", "fi")]
    d, lab = docs(spark, rows), labels(spark, [(100 + i, 1, 0) for i in range(20)])
    got = {r.doc_id: (r.verdict, r.keep) for r in ql.quality_scores(d, lab).collect()}
    assert got[1] == got[5] == ("unjudged", True) and got[2] == got[3] == got[4] == ("diverges", False) and got[6] == ("empty", False)
    assert {1, 5} <= {r.doc_id for r in ql.keep_quality(d, lab).collect()} and {r.doc_id for r in ql.keep_quality(d.drop("lang").withColumn("lang", ql.F.lit("en")), lab).collect()} >= {100}


def test_languages_with_the_most_training_texts(spark):
    text = lambda i: f"the house {i} on the hill and the river {i} " * 8
    rows = [(i, text(i), "en") for i in range(5)] + [(100 + i, text(50 + i), f"l{i}") for i in range(4)] + [(200, text(90), "b"), (201, text(91), "b")]
    assert set(li.train(docs(spark, rows), li.LangIdConfig(languages=2))) == {"en", "b"}
    assert len(li.train(docs(spark, rows))) == 6
