"""Substring dedup, license scans, nearest vectors and the pipeline."""

import random
import re

import numpy as np

from lensmark.llm import hashes, licences, neighbours, span_dedup


def prose(rng, n):
    return " ".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(5, 12))) + "." for _ in range(n))


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    passage, long = prose(rng, 8), prose(rng, 3000)
    rows = [(i, prose(rng, 6)) for i in range(20)]
    rows += [(100, f"{prose(rng, 2)} {passage} {prose(rng, 2)}"), (101, f"{prose(rng, 2)}\n{passage}\n{prose(rng, 2)}"), (102, passage), (103, long), (104, None), (105, ""), (106, "One. Two. One. Two."), (107, "One. Two. One. Two."), (None, passage)]
    rows += [(108, f"start. {passage} {passage} end.")]
    df = spark.createDataFrame([(*r, 1, "m", "n") for r in rows], "doc_id long, text string, n_removed int, id string, MARKS string")
    out = span_dedup.drop_repeated_spans(df)
    assert out.columns == ["doc_id", "text", "n_removed", "id", "MARKS", "n_sentences", "n_removed_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(r["n_removed"] == 1 and r["MARKS"] == "n" for r in got.values())
    before = dict(rows)
    for i in [*range(20), 100, 103, 104, 105, 106]:
        assert got[i]["text"] == before[i] and got[i]["n_removed_"] == 0
    flat = lambda s: re.sub(r"\s+", " ", s).strip()
    assert flat(got[101]["text"]) == flat(before[101].replace(passage, "")) and got[102]["text"] == got[None]["text"] == got[107]["text"] == ""
    assert flat(got[108]["text"]) == "start. end." and got[102]["n_removed_"] == got[101]["n_removed_"] == 8 and got[104]["n_sentences"] == 0
    assert span_dedup.drop_repeated_spans(df.limit(0)).count() == 0


def slow_parts(text):
    """Sentences of a text by the rules, word by word: start and words of each."""
    found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    data = text.encode()
    order = np.argsort(hashes.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)[2], kind="stable")
    rank = {int(w): r for r, w in enumerate(order)}  # the smallest word hash of a window has the smallest rank
    closers = "\"')]}*_`’”»›」』）】〉》"

    def groups(breaks):
        cuts = [0, *(i for i in range(1, len(found)) if i in breaks), len(found)]
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    bare = [w.rstrip(closers) for _, _, w in found]
    breaks = {i for i in range(1, len(found)) if bare[i - 1].endswith(tuple(".!?…。！？．｡؟۔।॥։")) or re.search("[\r\n]", text[found[i - 1][1] : found[i][0]])}
    for a, b in groups(set(breaks)):
        if b - a > 15:
            breaks |= {i for i in range(a + 1, b) if bare[i - 1].endswith(tuple(",;:，、；：､،؛"))}
    for a, b in groups(set(breaks)):
        for i in range(a, b - 14) if b - a > 15 else ():
            least = min(range(i, i + 15), key=lambda j: (rank[j], -j))
            same = [j for j in range(i, i + 15) if found[j][2] == found[least][2]]
            breaks.add(max(same))
    return [(found[a][0], tuple(w for _, _, w in found[a:b])) for a, b in groups(breaks)]


def slow_dedup(rows):
    """Texts by id: every run is looked up among all runs."""
    parts = {i: slow_parts(t) for i, t in rows}
    seen, gone = {}, {i: set() for i, _ in rows}
    for i, _ in sorted(rows):
        for a in range(len(parts[i])):
            for k in (2, 3):
                run = [w for _, w in parts[i][a : a + k]]
                if len(run) == k and (k == 3 or sum(map(len, run)) >= 20):
                    if (key := tuple(run)) in seen:
                        gone[i] |= set(range(a, a + k))
                    seen[key] = True
    out = {}
    for i, t in rows:
        starts = [s for s, _ in parts[i]] + [len(t)]
        out[i] = t[: starts[0]] + "".join(t[starts[j] : starts[j + 1]] for j in range(len(parts[i])) if j not in gone[i]) if gone[i] else t
    return out


def test_span_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    few = [f"s{i}" for i in range(12)]

    def sentence():
        n = rng.choice((1, 2, 3, 8, 14, 22, 40))
        w = [rng.choice(few) if rng.random() < 0.2 else f"r{rng.randrange(10**6)}" for _ in range(n)]
        return " ".join(x + rng.choice(["", "", "", "", "", ",", ";"]) for x in w) + rng.choice([".", "!", ".”", "。", "\n", " —"])

    pool = [sentence() for _ in range(60)]
    pool += ["Yes.", "No.", "And so on."]
    rows = [(i * 7 % 401, rng.choice(["", " ", "\n"]) + " ".join(rng.choice(pool) if rng.random() < 0.7 else sentence() for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: r["text"] for r in span_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = slow_dedup(rows)
    assert got == want and sum(want[i] != t for i, t in rows) > 30


def test_long_sentences_are_cut_at_pauses(spark):
    rng = random.Random(2)
    clause = lambda: " ".join(f"v{rng.randrange(9000)}" for _ in range(8))
    passage = ", ".join(clause() for _ in range(8))
    rows = [(1, f"{clause()} {passage} {clause()}."), (2, f"{clause()}, {clause()} {passage} {clause()}.")]
    got = {r["doc_id"]: r["text"] for r in span_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1]
    left = sum(w in set(passage.split()) for w in got[2].split())
    assert left <= 16


def test_passages_of_51_words_share_a_run_wherever_they_are_set():
    rng = random.Random(3)

    def passage(style):
        w = [f"p{rng.randrange(10**6)}" for _ in range(51)]
        for i in range(51):
            if style == "short" and i % 3 == 2 or style == "mixed" and rng.random() < 0.1:
                w[i] += "."
            elif style == "quoted" and i % 6 == 5:
                w[i] += ".”"
            elif style == "other" and i % 6 == 5:
                w[i] += "。"
            elif style in ("pauses", "mixed") and rng.random() < 0.1:
                w[i] += ","
        return " ".join(w)

    def host(n):
        return " ".join(f"h{rng.randrange(10**6)}" + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))

    def runs(text):
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        _, h, count, of = span_dedup.sentences(data, offsets)
        assert count.max() <= span_dedup.LONG
        return set(map(tuple, span_dedup.spans(h, count, of)[3].T.tolist()))

    for style in ["plain", "short", "mixed", "quoted", "other", "pauses"]:
        for _ in range(100):
            p = passage(style)
            one, two = (f"{host(rng.randrange(30))} {p} {host(rng.randrange(30))}" for _ in range(2))
            assert runs(one) & runs(two), (style, one, two)
        assert not runs(host(60)) & runs(host(60))


def test_mark_free_passages_go(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage = words(51)
    short = " ".join(f"{w}{'.' if i % 3 == 2 else ''}" for i, w in enumerate(words(51).split()))
    rows = [(i, f"{words(7)} {p} {words(9)}") for i, p in enumerate([passage, passage, short, short])]
    got = {r["doc_id"]: r["text"] for r in span_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[2] == rows[2][1]
    for i, p, least in ((1, passage, 21), (3, short, 45)):
        left = got[i].split()
        assert sum(w in set(p.split()) for w in left) <= 51 - least and sum(w in rows[i][1].split()[:7] + rows[i][1].split()[-9:] for w in left) == 16


def test_license_scan(spark):
    apache, mit = licences.TEMPLATES["Apache-2.0 header"], licences.TEMPLATES["MIT"]
    words = mit.split()
    words[20], words[60] = "changed", "altered"
    rng = random.Random(4)
    rows = [
        (1, f"{prose(rng, 20)} {apache} {prose(rng, 20)}"), (2, f"{prose(rng, 9)} {' '.join(words).upper()} {prose(rng, 3)}"), (3, prose(rng, 50)), (4, "Released under the MIT License."), (5, None), (6, ""), (7, "licensed under"),
        (8, f"{prose(rng, 900)}\nLicensed under CC BY-NC 4.0.\n{prose(rng, 900)}"), (9, " ".join(mit.split()[: len(words) // 2])), (8, "This work is licensed under the GNU General Public License, version 3."), (None, apache),
    ]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, license string, id int")
    got = sorted((r["doc_id"], r["license"], round(r["containment"], 3) == 1) for r in licences.license_scan(df).collect())
    assert got == [(1, "Apache-2.0 header", True), (1, "Apache-2.0 line", True), (2, "MIT", False), (4, "MIT line", True), (8, "CC-BY-NC-4.0 line", True), (8, "GPL-3.0 line", True)]
    cut = lambda s: [w for w in re.split(r"[^0-9A-Za-z]+", s.lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = []
    for i, text in rows:
        for k, t in licences.TEMPLATES.items():
            a, b = grams(cut(t)), grams(cut(text or ""))
            if i is not None and a and len(a & b) >= 0.8 * len(a):
                want.append((i, k, a <= b))
    assert got == sorted(want)
    assert licences.license_scan(df.limit(0)).count() == 0


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in {i: v for i, v in good if i % every == 0}.items():
        d = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d)]
    return sorted(out)


def test_nearest_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=16)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties at distance 0
    rows += [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] * 16), (2030, [1.0, None] * 8), (None, rows[1][1]), (2040, [float("inf")] * 16), (2050, [1.0, 2.0]), (2051, [1.5, 2.0])]
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    monkeypatch.setattr(neighbours, "TOGETHER", 7)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, query_id string")
    got = sorted(map(tuple, neighbours.nearest(df, 10, 10).collect()))
    want = brute(rows, 10, 10)
    assert len(got) == len(want)
    assert len({(x[0], x[2]) for x in got} & {(x[0], x[2]) for x in want}) >= 0.97 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in scores)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, neighbours.nearest(few).collect()))[0][:3] == (0, 1, brute(rows[:4], 10, 100)[0][2]) and neighbours.nearest(few).count() == 3
    assert neighbours.nearest(few.limit(0)).count() == 0


def test_recall_on_vectors_without_structure(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 1500)
    v = np.random.default_rng(9).normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[3000:3500] = v[17]  # a third of a block at one place
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(4000, (v[5] * 40).tolist()), (17, v[17].tolist())]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 100).collect()]
    want = brute(rows, 10, 100)
    assert len(got) == len(want) and len({(x[0], x[2]) for x in got} & {(x[0], x[2]) for x in want}) >= 0.95 * len(want)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    base = prose(rng, 30)
    near = base.split()
    near[9] = "other"
    passage = prose(rng, 9)
    texts = [prose(rng, 12) for _ in range(60)]
    texts = [f"{t} vileword nastyword." if i % 3 == 0 else t for i, t in enumerate(texts)]
    rows = list(enumerate(texts)) + [(100, base), (101, base.upper()), (102, " ".join(near)), (103, f"{prose(rng, 4)}\n{passage}"), (104, f"{prose(rng, 4)}\n{passage}"), (105, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    kept, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        ids.append({r[0] for r in kept.select("doc_id").collect()})
    toxic = {i for i in range(60) if i % 3 == 0}
    assert ids[0] == {i for i, _ in rows} - toxic and ids[1] == ids[0] - {100} and ids[2] == ids[1] - {102} and ids[3] == ids[2]
    texts = {r["doc_id"]: r for r in kept.collect()}
    assert passage in texts[103]["text"] and "." in texts[104]["text"] and passage[:40] not in texts[104]["text"]
    assert texts[104]["n_chars"] == len(texts[104]["text"]) and texts[1]["text"] == rows[1][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids[3]
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_near_stage_takes_five_words(spark):
    import corpus_pipeline

    words = [f"n{i}" for i in range(42)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, " ".join([*words, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 2}  # 0.81 by four words, 0.77 by five


def test_licenses_changed_inside_are_found(spark):
    rng = random.Random(8)
    cut = lambda s: [w for w in re.split(r"[^0-9A-Za-z]+", s.lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for i in range(400):
        name, text = rng.choice(sorted(licences.TEMPLATES.items()))
        w = cut(text)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1, 1))] = [f"z{rng.randrange(9999)}"]
        own = cut(prose(rng, rng.randrange(4))) + w[rng.randrange(2) :] + cut(prose(rng, rng.randrange(4)))
        rows.append((i, " ".join(own)))
        for k, t in licences.TEMPLATES.items():
            a = grams(cut(t))
            if len(a & grams(own)) >= 0.8 * len(a):
                want.add((i, k))
    got = {(r[0], r[1]) for r in licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len({k for _, k in got}) == len(licences.TEMPLATES)
