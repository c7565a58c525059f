"""The n-gram join, decontamination and licence scans against brute force."""

import random

import numpy as np
import pyarrow as pa
from conftest import DATA
from .helpers import awkward, benchmark, docs

from nestquery.llm import decontaminate as dc
from nestquery.llm import licenses as lc
from nestquery.llm import ngram_join as nj
from nestquery.llm import text as tx
from nestquery.llm.queries import ORACLE
from nestquery.llm.tables import table


def grams(text, n=3):
    w = tx.hash_words([text or ""])[0].tolist()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, threshold=0.5):
    """doc_id -> (class, copies, links) by all pairs."""
    sets = {i: frozenset(grams(t)) for i, t in rows if i is not None}
    every = {frozenset(grams(t)) for _, t in rows} - {frozenset()}  # rows without an id count as texts
    near = {x: [y for y in every if y != x and len(x & y) >= threshold * len(x | y)] for x in every}
    root = {}
    for x in every:
        todo = [] if x in root else [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = x
                todo += near[y]
    least = {}
    for i, x in sets.items():
        if x:
            least[root[x]] = min(i, least.get(root[x], i))
    return {i: (least[root[x]], sum(x == y for y in sets.values()), len(near[x])) if x else (i, 1, 0) for i, x in sets.items()}


def found(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in rows}


def family(rng, words, base, count, edits):
    for _ in range(count):
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(len(t))] = rng.choice(words)
        yield " ".join(t)


def test_join_is_exact(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for size in (1, 2, 3, 5, 9, 20, 60):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            texts += family(rng, words, base, 5, max(0, size // 12))
            texts += family(rng, words, base, 3, max(1, size // 6))
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in awkward("again and again " * 9000) if i is not None] + [(None, texts[0])]
    got = nj.jaccard_classes(docs(spark, rows))
    assert found(got) == brute_classes(rows)
    assert nj.jaccard_classes(docs(spark, [])).collect() == []
    assert found(nj.jaccard_classes(docs(spark, [(1, None), (None, "a")]))) == {1: (1, 1, 0)}


def small_texts():
    rng = random.Random(2)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([6, 12, 25])))) for i in range(80)]
    base = [rng.choice(words) for _ in range(24)]
    return rows + [(100 + i, t) for i, t in enumerate(family(rng, words, base, 60, 4))]


def test_join_by_signatures_alone(spark):
    """With labels that hold few pairs, the signatures yield the rest; and all over common n-grams."""
    rows = small_texts()
    for config in (nj.JoinConfig(labels=1, frequent=1, label_frequent=1), nj.JoinConfig(threshold=0.3)):
        assert found(nj.jaccard_classes(docs(spark, rows), config)) == brute_classes(rows, config.threshold)


def test_join_of_sets_that_differ_in_size(spark):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(90)]
    base = [rng.choice(words) for _ in range(100)]
    rows = [(k, " ".join(base[:n])) for k, n in enumerate([100, 96, 70, 50, 40, 30, 25, 21, 18, 12, 9, 5])] + [(20 + i, t) for i, t in enumerate(family(rng, words, base[:30], 20, 6))]
    for threshold, labels in ((0.15, 2), (0.2, 1), (0.4, 2), (0.8, 1), (1.0, 2)):
        config = nj.JoinConfig(threshold=threshold, labels=labels, frequent=2)
        assert found(nj.jaccard_classes(docs(spark, rows), config)) == brute_classes(rows, threshold)


def test_join_of_a_label_that_is_split(spark):
    rows = small_texts()
    for config in (nj.JoinConfig(label_group=7), nj.JoinConfig(label_group=1, bucket_bytes=1000), nj.JoinConfig(hot=2), nj.JoinConfig(hot=5, flush_rows=40)):
        assert found(nj.jaccard_classes(docs(spark, rows), config)) == brute_classes(rows)


def cluster(n, edits=(1, 3, 6, 10, 14), seed=8):
    """Rows of one text in ever other wording, of which the most edited are near few others, and texts that share a part."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(base if i % 9 else base[:30] + [f"v{rng.randrange(400)}" for _ in range(60)])
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    return rows


def test_join_of_large_clusters(spark):
    rows = cluster(260)
    want = brute_classes(rows)
    assert len({n for _, _, n in want.values()}) > 20 < max(n for _, _, n in want.values())
    for config in (nj.JoinConfig(crowd=2, sparse=1, labels=1), nj.JoinConfig(label_group=40)):
        assert found(nj.jaccard_classes(docs(spark, rows), config)) == want


def test_candidates_of_a_crowd():
    """3000 contents of one component and 20 others with the same 5 signatures: a row for each content, not for each pair."""
    n, rng = 3020, np.random.default_rng(9)
    content = np.arange(n, dtype=np.int64)
    marks = np.stack([rng.integers(0, 1 << 40, n), np.where(content < 3000, 0, content)], axis=1)
    q = np.repeat(np.arange(5, dtype=np.uint64), n)
    row = (0, nj._pack40(q), np.tile(content, 5).astype("<u4").tobytes(), content.tobytes(), np.full(n, 50, "<u4").tobytes(), marks.tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=[x.split()[0] for x in nj._SIGNED.split(", ")])
    rows = pa.Table.from_batches(nj._by_signature(nj.JoinConfig())(iter([batch])))
    assert rows.num_rows == n


def test_overlaps_of_rare_and_common_ngrams():
    rng = np.random.default_rng(10)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 20), rng.integers(100, 3000, 30)])).astype(np.uint64) for _ in range(300)]
    for split in (0, 120):
        got = {(i, j): n for a, b, c in nj.overlaps(sets, split, block=64, columns=16) for i, j, n in zip(a.tolist(), b.tolist(), c.tolist())}
        want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(300) for j in range(i + 1, 300) if not split or i < split <= j}
        assert got == {k: n for k, n in want.items() if n}


def test_join_with_other_ids(spark):
    rows = small_texts()
    want = {f"d{i:04d}": (f"d{c:04d}", n, k) for i, (c, n, k) in brute_classes(rows).items()}
    some = spark.createDataFrame([(f"d{i:04d}", t) for i, t in rows], "doc_id string, text string")
    assert found(nj.jaccard_classes(some)) == want
    assert sorted(r.doc_id for r in nj.keep_one(some).collect()) == sorted({c for c, _, _ in want.values()})
    few = spark.createDataFrame(rows, "doc_id int, text string")
    assert found(nj.jaccard_classes(few)) == brute_classes(rows) and nj.jaccard_classes(few).schema["class_id"].dataType.simpleString() == "int"


def test_join_of_the_table(spark, oracle):
    names, rows = oracle(ORACLE["op5_ngram_join"])
    assert names == ["doc_id", "class_id", "n_copies", "n_links"]
    assert found(nj.jaccard_classes(table(spark, DATA, "documents"))) == {r[0]: r[1:] for r in rows}


def test_one_of_each_group_stays(spark):
    copies = [(i, "one two three four five six seven eight") for i in range(10, 3010)]
    chain = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b c d e f g h l k"), (4, "z z z y y")]
    rows = copies + chain + [(None, chain[0][1]), (None, None), (5, None), (6, ""), (4, "z z z y y")]
    kept = nj.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([10, 1, 4, 4, 5, 6, None, None], key=str)
    assert nj.keep_one(docs(spark, [])).collect() == []
    limited = nj.keep_one(docs(spark, rows), nj.JoinConfig(broadcast_ids=10))
    assert limited.count() == 8


def brute_matches(rows, items, config):
    out = {}
    for i, t in rows:
        w = tx.hash_words([t or ""])[0]
        for j, item in items:
            v = tx.hash_words([item])[0]
            if len(v) >= config.n and len(w):
                score, _ = dc.align(v, w, config)
                if score >= config.threshold * config.match * len(v):
                    out[(i, j)] = round(score / (config.match * len(v)), 6)
    return out


def smith_waterman(a, b, config):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (config.match if a[i - 1] == b[j - 1] else config.mismatch), h[i - 1, j] + config.gap, h[i, j - 1] + config.gap)
    return int(h.max())


def test_alignment():
    rng, config = np.random.default_rng(3), dc.DecontaminationConfig()
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        assert dc.align(a, b, config)[0] == smith_waterman(a, b, config)


def test_decontamination_against_all_alignments(spark):
    config = dc.DecontaminationConfig()
    d, b = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    rows, items = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()]
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in dc.contaminated(d, b).collect()}
    want = brute_matches(rows, items, config)
    assert got == want
    dirty = {i for i, _ in got}
    assert {r.doc_id for r in dc.keep_clean(d, b).collect()} == {i for i, _ in rows} - dirty


def test_decontamination_of_edited_copies(spark):
    rng = random.Random(4)
    words = [f"q{i}" for i in range(4000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(20)]
    rows, planted = [], set()
    for k, (_, item) in enumerate(items):
        w = item.split()
        for edits in (0, 3, 6):
            e = list(w)
            for _ in range(edits):
                at = rng.randrange(len(e))
                e[at : at + 1] = rng.choice([[], [rng.choice(words)], [e[at], rng.choice(words)]])
            rows.append((len(rows), " ".join([rng.choice(words) for _ in range(100)] + e + [rng.choice(words) for _ in range(3000)])))
            planted.add((len(rows) - 1, k))
    clean = [(1000 + i, " ".join(rng.choice(words) for _ in range(300))) for i in range(100)]
    extra = [(9, items[0][1].split()[0]), (None, "a b c"), (9, None), (8, ""), (0, items[0][1]), (0, items[0][1])]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(spark, rows + clean), benchmark(spark, [(k, t, "x") for k, t in items + extra])).collect()}
    assert got == planted
    for d, b in (([], items), (rows, []), (rows, [(1, None), (None, None)])):
        assert dc.contaminated(docs(spark, d), benchmark(spark, [(k, t, "x") for k, t in b])).count() == 0
        assert dc.keep_clean(docs(spark, d), benchmark(spark, [(k, t, "x") for k, t in b])).count() == len(d)
    hit = [(None, items[3][1].upper()), (None, items[3][1])]
    assert [tuple(r)[:3] for r in dc.contaminated(docs(spark, hit + awkward()), benchmark(spark, [(3, items[3][1], "x")])).collect()] == [(None, 3, 1.0)] * 2
    many = dc.DecontaminationConfig(portion=200)  # several passes
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs(spark, rows), benchmark(spark, [(k, t, "x") for k, t in items]), many).collect()} >= {p for p in planted if p[0] % 3 < 2}


def test_decontamination_in_scripts_without_spaces(spark):
    rng = random.Random(5)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [(k, han(40) + "。", "x") for k in range(10)]
    rows = [(k, han(300) + t[:20] + "，" + t[20:] + han(300)) for k, t, _ in items] + [(50 + k, han(500)) for k in range(20)]
    got = {(r.doc_id, r.item_id, r.score) for r in dc.contaminated(docs(spark, rows), benchmark(spark, items)).collect()}
    assert got == {(k, k, 1.0) for k in range(10)}


def test_decontamination_with_other_ids(spark):
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([("a", " ".join(words)), ("b", "nothing of it")], "doc_id string, text string")
    for kind, item in (("int", 7), ("string", "i7"), ("smallint", 7)):
        b = spark.createDataFrame([(item, " ".join(words[5:30]))], f"item_id {kind}, text string")
        assert [(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()] == [("a", item)]
        assert [r.doc_id for r in dc.keep_clean(d, b).collect()] == ["b"]


def containment(words, template, k=2, more=0):
    """The greatest share of a template's shingles in a window of their number and ``more``."""
    want = {tuple(template[i : i + k]) for i in range(len(template) - k + 1)}
    m = len(want)
    best = 0.0
    for a in range(max(1, len(words) - m - more)):
        part = words[a : a + m + more + 1]
        best = max(best, len(want & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) / m)
    return best


def test_licences(spark):
    config = lc.LicenseConfig()
    rng = random.Random(6)
    filler = [f"f{i}" for i in range(500)]
    rows, want = [], set()
    names = sorted(config.templates)
    for k, name in enumerate(names):
        t = config.templates[name].split()
        rows.append((k, " ".join(rng.choice(filler) for _ in range(rng.randrange(300))) + " " + " ".join(t).upper() + " " + " ".join(rng.choice(filler) for _ in range(50))))
        want.add((k, name))
    got = [tuple(r) for r in lc.license_scan(docs(spark, rows)).collect()]
    assert want <= {(i, n) for i, n, _, _ in got}
    for i, n, share, _ in got:  # shorter templates that a longer one contains are matches too
        w = tx.hash_words([rows[i][1], config.templates[n]])
        assert containment(w[0].tolist(), w[1].tolist()) >= config.containment - 0.05 and share >= config.containment
    edited = [(i, t.replace("SOFTWARE", "PROGRAM", 1)) for i, t in rows if names[i] in ("MIT-text", "Apache-2.0-header")]
    assert {n for _, n, *_ in map(tuple, lc.license_scan(docs(spark, edited)).collect())} >= {"MIT-text", "Apache-2.0-header"}
    clean = [(i, " ".join(rng.choice(filler) for _ in range(400))) for i in range(50)]
    assert lc.license_scan(docs(spark, clean + awkward())).count() == 0 and lc.license_scan(docs(spark, [])).count() == 0
    assert config.collision(config.least_jaccard()) >= config.guarantee


def test_licences_of_the_table_against_all_windows(spark):
    config = lc.LicenseConfig()
    templates = lc.Templates(config)
    d = table(spark, DATA, "documents")
    want, most = set(), set()
    rows = [(r.doc_id, r.text) for r in d.collect()]
    words = [w.tolist() for w in tx.hash_words([t or "" for _, t in rows])]
    for name in templates.names:
        t = tx.hash_words([config.templates[name]])[0].tolist()
        pairs = {tuple(t[i : i + 2]) for i in range(len(t) - 1)}
        for (i, _), w in zip(rows, words):
            if len(pairs & set(zip(w, w[1:]))) >= config.containment * len(pairs) and containment(w, t) >= config.containment:
                want.add((i, name))
            # a match is verified in its window and a stride on either side
            if len(pairs & set(zip(w, w[1:]))) >= config.containment * len(pairs) and containment(w, t, more=2 * max(1, len(pairs) // 4)) >= config.containment:
                most.add((i, name))
    got = {(r.doc_id, r.license) for r in lc.license_scan(d).collect()}
    by = dict(zip([i for i, _ in rows], words))
    of = {n: tx.hash_words([config.templates[n]])[0].tolist() for n in templates.names}
    beaten = lambda i, n: any(containment(by[i], of[templates.names[j]]) > containment(by[i], of[n]) for j in templates.rivals[templates.names.index(n)])
    assert want and {x for x in want if not beaten(*x)} <= got <= most


def test_alike_licences(spark):
    rows = [(k, f"before {lc.TEMPLATES[n]} behind") for k, n in enumerate(("CC-BY-4.0", "CC-BY-SA-4.0-notice", "GPL-notice", "GPL-2.0-notice", "SPDX-GPL-3.0-only", "SPDX-MIT-0"))]
    rows.append((9, " and ".join([lc.TEMPLATES["GPL-notice"], "other words " * 100, lc.TEMPLATES["GPL-2.0-notice"]])))
    got = {}
    for r in lc.license_scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {0: {"CC-BY-4.0"}, 1: {"CC-BY-SA-4.0-notice"}, 2: {"GPL-notice"}, 3: {"GPL-2.0-notice"}, 4: {"SPDX-GPL-3.0-only"}, 5: {"SPDX-MIT-0", "SPDX-MIT"}, 9: {"GPL-notice", "GPL-2.0-notice"}}


def test_all_rights_reserved(spark):
    filler = " ".join(f"f{i}" for i in range(300))
    long = lc.TEMPLATES["All-rights-reserved"]
    rows = [(1, f"{filler}.\nAll rights reserved."), (2, "ALL RIGHTS RESERVED"), (3, f"{filler} all rights {filler} reserved"), (4, f"{filler}. {long} {filler}")]
    got = {(r.doc_id, r.license) for r in lc.license_scan(docs(spark, rows)).collect()}
    assert got == {(1, "All-rights-reserved-line"), (2, "All-rights-reserved-line"), (4, "All-rights-reserved-line"), (4, "All-rights-reserved")}
