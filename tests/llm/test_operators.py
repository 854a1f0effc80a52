"""The operators against brute force on small tables, and their defined results for odd rows."""

import gzip
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontolith.llm import backoff, chat, darts, decontaminate, embeddings, line_dedup, minhash, mixing, near, passages, toxicity, warc
from ontolith.llm import text as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def edited(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = draw.choice(WORDS)
    return " ".join(words)


def corpus(seed=0, base=14, copies=5):
    draw, rows = random.Random(seed), []
    for k in range(base):
        text = prose(draw, draw.choice([3, 40, 120, 300]))
        rows += [edited(draw, text, draw.choice([0, 0, 1, 2, 4, 12])) for _ in range(copies)]
    rows += [None, "", " .. ", "one", "one", "ONE!", prose(draw, 6000)]
    draw.shuffle(rows)
    return [(i, t, "en", f"s{i % 4}" if i % 5 else None, 1) for i, t in enumerate(rows)] + [(None, "null id", None, None, None), (3, rows[3], "en", "s3", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns({"h": F.lit(1), "key": F.lit("x"), "score": F.lit(2), "n_lines": F.lit(3)}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in linked:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# Kernels.
def test_words_and_bags():
    assert len(T.word_hashes("It's a—test, ÉÉ x_1")) == 5
    assert (T.word_hashes("Hello, WORLD") == T.word_hashes("hello\nworld!")).all()
    long = "a" * 5000
    assert T.word_hashes(f"{long} {long}b")[0] != T.word_hashes(f"{long} {long}b")[1]
    assert len(set(T.word_hashes(" ".join("x" * n for n in range(1, 130))).tolist())) == 129
    bag = T.text_bag("a b c d e a b c d e a b c d e")
    assert len(bag) == 11 == len(set(bag.tolist()))
    assert len(T.text_bag("a b")) == 1 and not len(T.text_bag(" ")) and not len(T.text_bag(None))
    assert T.similarity(T.text_bag(""), T.text_bag("")) == 0


@pytest.mark.parametrize("shared", [0.3, 0.8])
def test_dart_signatures_estimate_weighted_jaccard(shared):
    rng, got = np.random.default_rng(4), []
    for _ in range(30):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        n = int(round(800 * shared / (1 + shared)))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 400 - n).astype(np.uint64)])
        x, y = darts.signatures([a, b], 240)
        got.append((x == y).mean())
    assert abs(np.mean(got) - shared) < 0.02
    x, y = darts.signatures([a[:1], a[:1]], 240)
    assert (x == y).all()


# 1
def brute_classes(rows, least=0.8):
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts[i] = T.text_bag(t)
    same = [(i, j) for i, j in itertools.combinations(sorted(texts), 2) if T.similarity(texts[i], texts[j]) >= least]
    return components(texts, same)


def test_near_duplicates_equal_brute_force(docs):
    got = minhash.near_duplicates(docs).collect()
    want = brute_classes(corpus())
    assert len(got) == len(corpus())
    assert {(g.doc_id, g.class_id) for g in got if g.doc_id is not None} == set(want.items())
    assert all(g.kept == (g.doc_id == g.class_id) for g in got if g.doc_id is not None)
    assert [(g.class_id, g.kept) for g in got if g.doc_id is None] == [(None, True)]


def test_near_duplicates_in_dense_groups(spark):
    draw = random.Random(5)
    text = prose(draw, 150)
    rows = [(i, edited(draw, text, draw.choice([1, 2, 3, 5, 7])), None, None, None) for i in range(220)]
    got = {g.doc_id: g.class_id for g in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_in_a_large_dense_group(spark):
    """Most copies are linked to the first; the others need the join across classes, or are alone."""
    draw = random.Random(15)
    text, rows = prose(draw, 120), []
    for i in range(900):
        rows.append((i, edited(draw, text, draw.choice([1, 2, 3, 4, 6])), None, None, None))
    for i in range(900, 960):  # copies of copies, and cut ones
        rows.append((i, edited(draw, rows[i - 900][1], 2) if i % 2 else " ".join(rows[i - 900][1].split()[: draw.choice([60, 70, 100])]), None, None, None))
    got = {g.doc_id: g.class_id for g in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_classes(rows)
    assert 3 < len(set(got.values())) < 900


def test_links_across_components_equal_brute_force(spark):
    draw = random.Random(16)
    base = [prose(draw, 60) for _ in range(3)]
    texts = {i: edited(draw, base[i % 3], draw.choice([0, 1, 2, 3])) if i % 4 else " ".join(base[i % 3].split()[: draw.choice([45, 50, 55, 60])]) for i in range(150)}
    ids = spark.createDataFrame([(i, i % 40) for i in texts], "id long, component long")
    df = spark.createDataFrame([*texts.items()], "id long, text string")
    got = {(r.b, r.a) for r in near.across(ids, df, 0.8, lambda a, b: a != b).where("sim >= 0.8").collect()}
    bags = {i: T.text_bag(t) for i, t in texts.items()}
    want = {(i, j) for i, j in itertools.combinations(texts, 2) if i % 40 != j % 40 and T.similarity(bags[i], bags[j]) >= 0.8}
    assert got == want and len(want) > 100


def test_near_duplicates_odd_rows(spark, none):
    assert minhash.near_duplicates(none).count() == 0
    rows = [(1, "a b c d e f", None, None, None), (1, "other words of the same id", None, None, None), (2, "a b c d e f", None, None, None)]
    got = {(g.doc_id, g.class_id) for g in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 1), (2, 1)}


# 2
def brute_leaks(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        w = T.word_hashes(t or "")
        for i, it in items:
            v = T.word_hashes(it or "")
            if not len(v) or not len(w):
                continue
            bag, n = T.bag(T.shingle_hashes(v)), min(len(v), len(w))
            best = max(T.similarity(T.bag(T.shingle_hashes(w[k : k + n], min(5, len(v)))), bag) for k in range(len(w) - n + 1))
            if best >= least:
                out[(d, i)] = round(best, 9)
    return out


def test_contamination_equals_brute_force(spark):
    draw = random.Random(2)
    items = [(i, prose(draw, draw.choice([3, 9, 20, 35, 60]))) for i in range(12)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for i in range(40):
        t = prose(draw, 80).split()
        for _ in range(draw.choice([0, 1, 2])):
            it = edited(draw, items[draw.randrange(12)][1], draw.choice([0, 0, 0, 1]))
            t[draw.randrange(len(t)) : 0] = it.upper().split()
        docs.append((i, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1])]
    df, bm = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = {(g.doc_id, g.item_id): round(g.similarity, 9) for g in decontaminate.contaminated(df, bm).collect()}
    assert got == brute_leaks(docs, items)
    clean = {g.doc_id for g in decontaminate.clean(df, bm).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(df, bm.limit(0)).count() == 0 == decontaminate.contaminated(df.limit(0), bm).count()


def test_reordered_items_are_contamination(spark):
    draw = random.Random(21)
    own = lambda n, c: [f"{c}{draw.randrange(10**8)}" for _ in range(n)]
    items, docs = [], []
    for i, size in enumerate([100, 60, 100, 80]):
        a = own(size, "i")
        items.append((i, " ".join(a)))
        for k, cut in enumerate([size // 2, 12, size - 9]):
            docs.append((10 * i + k, " ".join([*own(30, "j"), *a[cut:], *a[:cut], *own(25, "j")])))
        docs.append((10 * i + 5, " ".join([*a[7:], *a[:7]])))
        docs.append((10 * i + 6, " ".join([*own(30, "j"), *a[: size // 2], *own(30, "j"), *a[size // 2 :]])))
        docs.append((10 * i + 7, " ".join(a[: size - 5])))
    df, bm = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(g.doc_id, g.item_id): round(g.similarity, 9) for g in decontaminate.contaminated(df, bm).collect()}
    wanted = brute_leaks(docs, items)
    assert {(10 * i + k, i) for i in range(4) for k in (0, 1, 2, 5, 7)} <= set(wanted)
    assert got == wanted


# 3
def test_toxicity_learns_and_ignores_groups(spark):
    draw, rows, labels = random.Random(3), [], []
    for i in range(900):
        bad = i % 6 == 0
        text = prose(draw, 30)
        if bad:
            text += " " + draw.choice(["nastyword", "vileword", "rudeword"]) + (" women" if i % 12 else "")
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "nastyword vileword"), (2002, "nastyword " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "source": F.lit("s")})
    known = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g for g in toxicity.score(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got.values())
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items() if i is not None)
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[None].predicted == got[2002].predicted == 1 and got[2000].score == got[2001].score < 0.3
    assert toxicity.score(docs.limit(0), known).count() == 0
    assert toxicity.score(docs, known.limit(0)).where("predicted = 0").count() == len(rows)


def test_counterfactuals_take_weight_off_groups():
    draw = random.Random(1)
    texts = [prose(draw, 60) + (f" {draw.choice(['vileword', 'rudeword', 'nastyword'])} women" if i % 2 else "") for i in range(400)]
    label = [i % 2 for i in range(400)]
    with_penalty, b = toxicity.fit(texts, label)
    without, b0 = toxicity.fit(texts, label, penalty=0.0)
    assert abs(with_penalty.get("women", 0)) < 0.25 * without["women"]
    assert with_penalty["vileword"] > 0.5
    assert toxicity.counterfactuals({"the", "men", "sing"}, {"men": ("women", "men")}) == [("men", "women"), ("men", None)]
    neutral = [f"{prose(draw, 30)} {w} {prose(draw, 30)}" for line in toxicity.IDENTITY_TERMS for w in line for _ in range(3)]
    wrong = [int((toxicity.scorer(*m)(neutral) >= toxicity.THRESHOLD).sum()) for m in ((with_penalty, b), (without, b0))]
    assert wrong[0] < wrong[1]


def test_fit_equals_plain_gradient_descent():
    """The same loss, written out densely and minimised by small plain steps."""
    draw = random.Random(2)
    terms = (("women", "men"),)
    texts = [" ".join(draw.choice("abcdefgh") * 2 for _ in range(6)) + (" bad" if i % 3 == 0 else "") + draw.choice([" women", " men", ""]) for i in range(90)]
    label = [int(i % 3 == 0) for i in range(90)]
    got, b = toxicity.fit(texts, label, terms=terms, penalty=2.0, ridge=0.1, rounds=4000)
    y, sets = np.array(label, float), [toxicity.features(t) for t in texts]
    names = sorted(set().union(*sets))
    seen = np.array([sum(f in s for s in sets) for f in names])
    bad = np.array([sum(f in s for s, k in zip(sets, label) if k) for f in names])
    rate = y.mean()
    weight = np.abs(bad - rate * seen) / np.sqrt(seen * rate * (1 - rate) + 1.0)
    keep = [f for f, n, w in zip(names, seen, weight) if n >= 3 and w >= toxicity.SCREEN or f in toxicity.features("women men")]
    scale = np.array([np.clip(weight[names.index(f)] / 6.0, 0.02, 1.0) for f in keep])
    row = lambda s: np.array([f in s for f in keep], float) * scale
    x = np.stack([row(s) for s in sets])
    gaps, turn = [], 0
    for t in texts:
        words = t.split()
        if not {"women", "men"} & set(words):
            words, turn = [*words, ("women", "men")[turn % 2]], turn + 1
        for w in sorted({"women", "men"} & set(words)):
            for other in ({"women", "men"} - {w}).pop(), "":
                gaps.append(row(toxicity.features(" ".join(words))) - row(toxicity.features(" ".join(other if v == w else v for v in words))))
    z = np.stack([g for g in gaps if g.any()])
    v, c = np.zeros(len(keep)), np.log(rate / (1 - rate))
    for _ in range(60_000):
        g = 1 / (1 + np.exp(-(x @ v + c))) - y
        v, c = v - 0.05 * (x.T @ g / len(y) + 0.1 * v / len(y) + 4.0 * z.T @ (z @ v) / len(z)), c - 0.05 * g.mean()
    want = dict(zip(keep, v * scale))
    assert abs(b - c) < 0.02 and all(abs(got.get(f, 0.0) - w) < 0.02 for f, w in want.items())


# 4
def test_archives_round_trip(spark, tmp_path):
    pages = [(5, "http://a/ b", "same"), (2, None, "same"), (9, "http://c", "ü" * 3_000_000), (7, "x", None), (8, "y", ""), (None, "z", "same"), (2, None, "same"), (11, "n", "WARC/1.1\r\n\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"path": F.lit("p"), "digest": F.lit("d")}).coalesce(1)
    got = warc.archive(df, folder=f"file://{tmp_path}").collect()
    assert len(got) == len(pages)
    for g in got:
        html = next(h for i, _, h in pages if i == g.page_id) or ""
        assert (g.payload_bytes, g.payload_digest) == (len(html.encode()), warc.base32_sha1(html.encode()))
    kinds = sorted((str(g.page_id), g.record_type, g.refers_to) for g in got)
    assert kinds == sorted([("5", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("9", "response", None), ("7", "response", None), ("8", "revisit", 7), ("None", "revisit", 2), ("11", "response", None)])
    files = [*(tmp_path / "normalised").glob("*.warc.gz")]
    lines = [(f, *x.split()) for f in files for x in (f.parent / f"{f.name}.idx").read_text().splitlines()]
    assert len(lines) == len(pages)
    for f, offset, length, urn, kind in lines:
        member = gzip.decompress(f.read_bytes()[int(offset) : int(offset) + int(length)]).decode()
        assert member.startswith(f"WARC/1.1\r\nWARC-Type: {kind}\r\n") and urn in member and member.endswith("\r\n\r\n")
    assert warc.archive(df, least=5, folder=f"file://{tmp_path}/b").where("record_type = 'revisit'").count() == 0
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_have_bounded_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 10)
    df = spark.createDataFrame([(i, "u", "") for i in range(95)], "page_id long, url string, html string").coalesce(1)
    got = warc.archive(df, folder=f"file://{tmp_path}").collect()
    assert len(got) == 95 and sum(g.record_type == "response" for g in got) == 1
    assert not (tmp_path / "monolithic").exists()


def test_damaged_archives_raise(tmp_path):
    record = warc.response(1, "http://a", b"x" * 100)[0]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record * 3)[:-30])
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise_file(f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/out.warc.gz")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record * 2))
    assert warc.normalise_file(f"file://{tmp_path}/b.warc.gz", f"file://{tmp_path}/b2.warc.gz") == 3


# 5
def brute_lines(rows, width=3):
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    seen, gone = set(), {}
    for null, i, t in order:
        lines, cut = t.split("\n"), set()
        for k in range(len(lines) - width + 1):
            w = tuple(lines[k : k + width])
            if w in seen:
                cut |= set(range(k, k + width))
            seen.add(w)
        gone[(None if null else i, t)] = "\n".join(x for k, x in enumerate(lines) if k not in cut), len(cut)
    return gone


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(9)
    rows = [(i, "\n".join(draw.choice("abcd") for _ in range(draw.randrange(9)))) for i in range(60)] + [(61, None), (62, ""), (None, "a\nb\nc"), (63, "x\ny"), (5, "q\nq\nq\nq")]
    rows = [*{r[0]: r for r in rows}.values()] + [(7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pos": F.lit(0), "h1": F.lit(0), "n_lines": F.lit("z")})
    got, want = line_dedup.drop_repeated_lines(df).collect(), brute_lines(rows)
    assert len(got) == len(rows)
    for g in got:
        src = [t for i, t in rows if i == g.doc_id]
        if g.text is None:
            assert None in src and (g.n_lines, g.n_removed) == (0, 0)
        else:
            assert (g.text, g.n_removed) in [want[(g.doc_id, t)] for t in src if t is not None]
    twice = line_dedup.drop_repeated_lines(spark.createDataFrame([(1, "a\nb\nc")] * 2, "doc_id long, text string")).collect()
    assert [t.text for t in twice] == ["a\nb\nc"] * 2
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    long = [(1, "\n".join(f"line {i}" for i in range(60_000))), (2, "\n".join([*(f"own {i}" for i in range(20_000)), *(f"line {i}" for i in range(50_000))]))]
    cut = {g.doc_id: g for g in line_dedup.drop_repeated_lines(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert (cut[1].n_removed, cut[2].n_removed) == (0, 50_000) and cut[2].text.endswith("own 19999")


# 6
def talk(draw):
    rows = []
    lines = lambda n, m: "\n".join(prose(draw, m) for _ in range(n))
    for c in range(80):
        rows += [(c, 0, "system", prose(draw, 15))] if c % 3 == 0 else []
        rows += [(c, k, "user" if k % 2 else "assistant", prose(draw, 12) if k % 2 else lines(draw.choice([1, 2, 4]), 90)) for k in range(1, 8)]
    return rows


def test_turns_and_roles_are_recovered(spark):
    draw = random.Random(4)
    rows = talk(draw)
    rows += [(99, k, "user" if k % 2 else "assistant", prose(draw, 12 if k % 2 else 90)) for k in range(1, 900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(0), "at": F.lit(1), "n": F.lit("x")})
    got = chat.recover(df).collect()
    want = {}
    for c, _, r, t in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(c, []).append((r, t))
    have = {}
    for g in sorted(got, key=lambda g: (g.conv_id, g.turn, g.piece)):
        have.setdefault(g.conv_id, []).append((g.role, g.content))
    right = sum(len(set(have[c]) & set(want[c])) for c in want)
    assert right > 0.95 * len(rows)
    assert all(g.rendered == f"<|im_start|>{g.role}\n{g.content}<|im_end|>\n" for g in got if not g.piece and g.turn == 0 and g.conv_id < 80)


def test_parts_make_no_difference(spark):
    draw = random.Random(5)
    rows = [*talk(draw), *[(99, k, "user" if k % 2 else "assistant", prose(draw, 12 if k % 2 else 90)) for k in range(1, 200)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat.transcripts(df)
    model = chat.train(lines.where("state IS NOT NULL"), chat.known_turns(df))
    results = []
    for part, fan in ((10**6, 512), (90, 512), (23, 3)):
        rendered = {}
        for g in chat.render(chat.parse(lines.select("conv_id", "fold", "at", "line"), model, part, fan)).orderBy("conv_id", "turn", "piece").collect():
            rendered[g.conv_id] = rendered.get(g.conv_id, "") + g.rendered
        results.append(rendered)
    assert results[0] == results[1] == results[2]


def test_transcripts_of_odd_rows(spark, none):
    rows = [(None, 1, "user", "hello")] * 300 + [(500, 1, None, None), (501, None, "user", ""), (502, 1, "narrator", "x"), (503, 1, "user", "w " * 50_000)] + talk(random.Random(6))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.recover(df).collect()
    assert {g.conv_id for g in got} == {r[0] for r in rows} and all(g.role in chat.ROLES for g in got)
    assert sum(g.content.count("hello") for g in got if g.conv_id is None) == 300
    assert max(len(g.content) for g in got) >= 99_000
    assert chat.recover(df.limit(0)).count() == 0
    long = "\n".join(prose(random.Random(7), 90) for _ in range(2))
    one = spark.createDataFrame([(1, f"User: hi there\nAssistant: {long}"), (2, None)], "conv_id long, text string")
    model = chat.train(chat.transcripts(df).where("state IS NOT NULL"), chat.known_turns(df))
    parsed = sorted((g.conv_id, g.turn, g.role, g.content) for g in chat.parse(chat.split(one), model).collect())
    assert parsed[0][2:] == ("user", "hi there") and parsed[1][2:] == ("assistant", long) and len(parsed) == 3


def test_viterbi_equals_all_paths():
    rng, k, n = np.random.default_rng(0), chat.STATES, 4
    model = {"start": rng.normal(size=(2, k)), "move": rng.normal(size=(2, k, k)), "look": rng.normal(size=(2, k, chat.BLANK + 1, len(chat.WORDS) + 1))}
    kind, shape = rng.integers(0, 5, 2 * n), rng.integers(0, 8, 2 * n)
    which, first, into, onto = np.array([0, 1]), np.array([True, False]), rng.normal(size=(2, k)), rng.normal(size=(2, k))
    into[0] = 0
    got = chat.viterbi(model, which, kind, shape, first, np.array([n, n]), into.copy(), onto)
    for r in range(2):
        def score(path, before):
            out, s = into[r][before], before  # noqa: B023
            for t, x in enumerate(path):
                out += (model["start"][r][x] if t == 0 and first[r] else model["move"][r][s, x]) + model["look"][r, x, kind[r * n + t], shape[r * n + t]]  # noqa: B023
                s = x
            return out + onto[r][s]  # noqa: B023
        best = max(max(score(p, b) for b in ([0] if first[r] else range(k))) for p in itertools.product(range(k), repeat=n))
        assert abs(max(score(tuple(got[r * n : r * n + n]), b) for b in range(k)) - best) < 1e-9
        m = chat.matrix(model, r, kind[r * n : r * n + n], shape[r * n : r * n + n], bool(first[r]))
        assert abs((into[r][:, None] + m + onto[r][None]).max() - best) < 1e-9


# 7
@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 30, None: 5}, {"a": 0, "b": 7}, {"x": 9}, {str(i): i * i for i in range(9)}])
def test_targets_equal_water_filling(spark, sizes):
    """Targets found by raising all open sources a little at a time, instead of by closing rounds."""
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([*sizes.items()], "source string, size long")).collect()}
    order = sorted(sizes, key=lambda x: (x is None, x))
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(order)}
    total, low, high = 1.5 * sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[k], level * weight[k]) for k in order) < total else (low, level)
    assert all(abs(got[k] - min(2 * sizes[k], low * weight[k])) < 1e-6 for k in order)


def test_mix_of_repeated_rows(spark):
    rows = [(1, "one two three", "s")] * 9000 + [(None, "a b", "s")] * 9000 + [(2, "w " * 40_000, "t"), (3, None, None)]
    df = spark.createDataFrame(rows, DOCS.replace(", lang string", "").replace(", n_chars long", "")).withColumns({"copy": F.lit(0), "n": F.lit(1)})
    got = mixing.mix(df, rows_per_block=1000).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), rows_per_block=1000).collect()))
    taken = sum(g.taken for g in got if g.doc_id in (1, None) and g.size)
    assert abs(taken - next(g.target for g in got if g.doc_id == 1)) <= 3


def test_mix_meets_its_targets(spark, docs, none):
    draw = random.Random(6)
    rows = [(i, prose(draw, draw.choice([1, 5, 30, 200])), None, ["b", "a", None, "c"][min(3, int(draw.random() * 9))], None) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, rows_per_block=64).collect()
    again = mixing.mix(df.repartition(7), rows_per_block=64).collect()
    assert sorted(got) == sorted(again) and len(got) == 3000
    assert all(g.taken in (0, g.size, 2 * g.size) for g in got)
    source = {i: s for i, _, _, s, _ in rows}
    for s in ("a", "b", "c", None):
        mine = [g for g in got if source[g.doc_id] == s]
        assert abs(sum(g.taken for g in mine) - mine[0].target) <= 200 and mine[0].target <= 2 * mine[0].source_size == 2 * sum(g.size for g in mine)
    assert abs(sum({source[g.doc_id]: g.target for g in got}.values()) - 1.5 * sum(g.size for g in got)) < 1e-6
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0
    assert {g.taken for g in mixing.mix(docs).where("size = 0").collect()} == {0}


# 8
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, docs, none, order):
    rows = [(i, t) for i, t, *_ in corpus()]
    words = [T.word_hashes(t or "").tolist() for _, t in rows]
    every, own = {}, []
    for w in words:
        mine = {}
        for k in range(1, order + 1):
            for i in range(len(w) - k + 1):
                mine[tuple(w[i : i + k])] = mine.get(tuple(w[i : i + k]), 0) + 1
        own.append(mine)
        for g, n in mine.items():
            every[g] = every.get(g, 0) + n
    total, want = sum(map(len, words)), []
    for (d, _), w, mine in zip(rows, words, own, strict=True):
        left = lambda g: every[g] - mine[g]  # noqa: E731, B023
        micro = back = 0
        for i, x in enumerate(w):
            most = k = min(order, i + 1)
            while k > 1 and not left(tuple(w[i - k + 1 : i + 1])):
                k -= 1
            n, of = (left(tuple(w[i - k + 1 : i + 1])), left(tuple(w[i - k + 1 : i]))) if k > 1 else (max(1, left((x,))), max(1, total - len(w)))
            micro, back = micro + round(1e6 * np.log(0.4 ** (most - k) * n / of)), back + (k < most)
        want.append((d, len(w), back, micro))
    got = [(g.doc_id, g.words, g.backoffs, g.score_micro) for g in backoff.scores(docs, order=order, chunk_bytes=5000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scores_of_odd_rows(spark, none):
    assert backoff.scores(none).count() == 0
    rows = [(1, "a b c d")] * 5000 + [(None, "a b"), (None, "a b"), (2, None), (3, ""), (4, "z " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gram": F.lit(1), "n": F.lit("x"), "chunk": F.lit(0)})
    got = backoff.scores(df).collect()
    assert len(got) == len(rows) and len({tuple(g) for g in got if g.doc_id == 1}) == 1
    assert {(g.words, g.backoffs, g.score_micro) for g in got if g.doc_id in (2, 3)} == {(0, 0, 0)}
    assert {g.backoffs for g in got if g.doc_id in (1, None)} == {0} and [g.backoffs for g in got if g.doc_id == 4] == [29_999]


# 9
def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    v, lab = [], []
    for c in range(25):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            z = rng.normal(size=24)
            v.append((base / np.linalg.norm(base) + rng.uniform(0.05, 0.5) * z / np.linalg.norm(z)).astype(np.float32))
            lab.append(c % 3)
    base = rng.normal(size=24)
    v += [(base + 0.02 * rng.normal(size=24)).astype(np.float32) for _ in range(320)] + [v[3]] * 9
    lab += [1] * 320 + [lab[3]] * 9
    rows = [(i, [float(x) for x in e], int(k)) for i, (e, k) in enumerate(zip(v, lab, strict=True))]
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] * 24, 1), (9005, rows[0][1], None), (9006, [float("inf")] * 24, 1), (9007, [], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(0))
    got = {g.vec_id: g for g in embeddings.near_vectors(df).collect()}
    e = np.stack(v).astype(float)
    e /= np.linalg.norm(e, axis=1)[:, None]
    near = (e @ e.T >= 0.93) & (np.array(lab)[:, None] == np.array(lab)[None])
    np.fill_diagonal(near, False)
    want = components(range(len(v)), zip(*np.nonzero(near), strict=True))
    exact = [got[i].n_links == near[i].sum() for i in range(len(v))]
    assert np.mean(exact) > 0.99 and all(got[i].n_links <= near[i].sum() for i in range(len(v)))
    assert sum(got[i].component_id == want[i] for i in range(len(v))) > 0.99 * len(v)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


# 10
def brute_anchors(w, span):
    h = [int(T.mixed(T.mixed(w[i : i + 1] * passages._A) if i == len(w) - 1 else w[i : i + 1] * passages._A ^ w[i + 1 : i + 2])[0]) if i < len(w) - 1 else int(T.mixed(w[i : i + 1] * passages._A)[0]) for i in range(len(w))]
    return sorted({max(range(i, i + span), key=lambda k: (-h[k], k)) for i in range(len(w) - span + 1)})


def units_of(rows):
    """The paragraphs by brute force: (doc, word, size, words) of both kinds."""
    out = []
    for d, t in rows:
        w, long = T.word_hashes(t), False
        for span, length, banded in ((passages.SPAN, passages.SHORT, False), (passages.LONG_SPAN, passages.LONG, True)):
            for a in brute_anchors(w, span):
                if a + length <= len(w):
                    out.append((d, a, length, banded, tuple(w[a : a + length].tolist())))
                    long |= banded
        if not long and len(w):
            out.append((d, 0, len(w), True, tuple(w.tolist())))
    return out


def brute_passages(rows, least=0.8):
    """Removed words of each document: clusters by all pairs, runs grown word by word."""
    words = {d: T.word_hashes(t).tolist() for d, t in rows}
    units = units_of(rows)
    first, pairs = {}, []
    for u in sorted(units):
        first.setdefault(u[2:], u[:2])
    long = {u[2:]: first[u[2:]] for u in units if u[3]}
    bags = {p: T.bag(T.shingle_hashes(np.array(k[2], np.uint64))) for k, p in long.items()}
    for (p, x), (q, y) in itertools.combinations(bags.items(), 2):
        if (p[0] != q[0] or abs(p[1] - q[1]) >= passages.LONG) and T.similarity(x, y) >= least:
            pairs.append((p, q))
    root = components(bags, pairs)
    again = {}
    for d, w, n, banded, k in units:
        rd, rw = root[first[(n, banded, k)]] if banded else first[(n, banded, k)]
        if (d, w) != (rd, rw) and (d != rd or w >= rw + n):
            again.setdefault(d, []).append((w, w + n, rd, w - rw))
    gone = {}
    for d, rows_of in again.items():
        runs, last = [], None
        for a, b, rd, shift in sorted(rows_of):
            if not runs or a > runs[-1]["end"] + (passages.SPAN if last == (rd, shift) else 0):
                runs.append({"first": a, "end": b, "head": (rd, shift), "tail": (b, a, rd, shift)})
            runs[-1]["end"], runs[-1]["tail"] = max(b, runs[-1]["end"]), max((b, a, rd, shift), runs[-1]["tail"])
            last = (rd, shift)
        for r in runs:
            a, b, x = r["first"], r["end"], words[d]
            low, high, (rd, shift) = a, b, r["head"]
            y = words[rd]
            while low > 0 and low - shift > 0 and a - low < passages.AROUND and x[low - 1] == y[low - 1 - shift]:
                low -= 1
            if low == a:
                low += next((k for k in range(passages.EDGE + 1) if a + k < len(x) and a + k - shift < len(y) and x[a + k] == y[a + k - shift]), 0)
            _, _, rd, shift = r["tail"]
            y = words[rd]
            while high < len(x) and high - shift < len(y) and high - b < passages.AROUND and x[high] == y[high - shift]:
                high += 1
            if high == b:
                high -= next((k for k in range(passages.EDGE + 1) if x[b - 1 - k] == y[b - 1 - k - shift]), 0)
            gone.setdefault(d, set()).update(range(low, high))
    return gone


def test_anchors_cover_every_window():
    w = T.word_hashes(prose(random.Random(0), 3000))
    at = passages.anchors(w, np.zeros(len(w), int), passages.SPAN)
    assert all(((at >= i) & (at < i + passages.SPAN)).any() for i in range(len(w) - passages.SPAN + 1))
    assert at.tolist() == brute_anchors(w, passages.SPAN)
    assert len(set(passages.run_hashes(w, 25).tolist())) > 2900
    assert (passages.run_hashes(w[7:], 25) == passages.run_hashes(w, 25)[7:]).all()


def test_words_of_many_texts_equal_those_of_each():
    """One pass over texts, cut between them, gives the words of each."""
    texts = ["", None, "One", " two,THREE ", "x" * 90 + " é_1", "a b " * 200_000, "..", "last"]
    words, size = T.words_of(texts)
    want = [T.word_hashes(t or "") for t in texts]
    assert size.tolist() == [len(w) for w in want] and words.tolist() == np.concatenate(want).tolist()
    assert [len(x) for x in T.words_of([])] == [0, 0]


def test_backoff_reads_the_rows_of_a_part_only(spark, docs, monkeypatch):
    """Each of several parts reads a folder of its own, and the rows are those of one part."""
    at, real = [], backoff.written

    def recorded(df, name, *folders):
        at.append((name, folders))
        return real(df, name, *folders)

    monkeypatch.setattr(backoff, "written", recorded)
    one = sorted(map(str, backoff.scores(docs).collect()))
    assert not any(folders for _, folders in at)
    at.clear()
    assert sorted(map(str, backoff.scores(docs, chunk_bytes=300).collect())) == one
    assert {name for name, folders in at if folders == ("part",)} == {"rows", "words", "counts2", "counts3"}


def test_toxicity_is_fitted_off_the_driver(spark, monkeypatch):
    """No text reaches the driver's Python, which gets the weights only."""
    rows = [(i, f"vile{i % 3} words here" if i % 2 else f"kind{i % 3} words there") for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    want = toxicity.train(docs, labels)
    real = toxicity.fit

    def refuse(texts, *_):
        assert not texts
        return real(texts, *_)

    monkeypatch.setattr(toxicity, "fit", refuse)
    assert toxicity.train(docs, labels) == want and len(want[0]) > 2
    assert toxicity.train(docs, labels.limit(0)) == ({}, -4.0)


def test_first_of_groups_holds_no_group(spark):
    """Firsts and singles of groups, by a plan without an aggregate or a join."""
    rows = [(k, i) for k in range(6) for i in range(k * k + 1)]
    first, alone = near.first_of(["k"], "i")
    got = spark.createDataFrame(rows, "k long, i long").repartition(7).select("k", "i", first.alias("first"), alone.alias("alone"))
    assert "Aggregate" not in (plan := got._jdf.queryExecution().toString()) and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == [(k, i, i == 0, k == 0) for k, i in sorted(rows)]


def test_passages_equal_brute_force(spark):
    draw = random.Random(18)
    own = lambda n: " ".join(f"c{draw.randrange(10**6)}" for _ in range(n))
    shared = [own(n) for n in (30, 51, 60, 90, 140)]
    rows = []
    for i in range(70):
        text = own(draw.choice([3, 20, 60, 150])).split()
        for _ in range(draw.choice([0, 1, 2])):
            text[draw.randrange(len(text)) : 0] = edited(draw, draw.choice(shared), draw.choice([0, 0, 1, 2])).split()
        rows.append((i * 7 - 100, " ".join(text)))
    rows += [(900, rows[3][1]), (901, "one two"), (902, "one two"), (903, own(49)), (2**62, own(1))]
    rows += [(904, rows[-2][1]), (-(2**62), f"{shared[4]} {own(5)} {shared[4]}")]
    got = {}
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT kept").collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    want = brute_passages(rows)
    assert got == want and len(want) > 30 and 904 in want and 902 in want


def test_repeated_passages_are_removed_from_end_to_end(spark, none):
    draw = random.Random(8)
    passage, other = " ".join(f"p{draw.randrange(10**6)}" for _ in range(51)), " ".join(f"o{draw.randrange(10**6)}" for _ in range(140))
    clean = lambda n: " ".join(f"c{draw.randrange(10**8)}" for _ in range(n))
    line = "a common line of nine words in many texts"
    rows = [(i, f"{clean(60)} {line} {clean(50)}") for i in range(10)]
    rows += [(20 + i, f"{clean(i * 7)} {passage.upper()}. {clean(30)}") for i in range(8)] + [(40, f"{other} {clean(9)}"), (41, f"{clean(30)}\n{other}"), (42, f"{clean(40)} {other} {clean(60)} {other}")]
    rows += [(60, None), (61, ""), (None, passage), (62, "short"), (20, rows[10][1]), (63, " .. ")]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "id": F.lit("x"), "size": F.lit(2)})).collect()
    gone = {(g.doc_id, g.first_word, g.n_words) for g in got if not g.kept}
    assert gone == {(20 + i, i * 7, 51) for i in range(1, 8)} | {(41, 30, 140), (42, 40, 140), (42, 240, 140)}
    assert {(g.doc_id, g.first_word) for g in got if g.kept} >= {(20, 0), (40, 0)}
    assert all(g.class_doc in (range(20, 28) if g.doc_id < 40 else (40,)) for g in got if not g.kept)
    assert passages.repeated(none).count() == 0


def test_passages_of_very_long_texts(spark):
    draw = random.Random(19)
    words = [f"x{i}" for i in range(2_200_000)]
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(60))
    rows = [(0, " ".join([*words, passage])), (1, f"{passage} tail"), (-5, "y " * 40)]
    got = [(g.doc_id, g.first_word, g.n_words) for g in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT kept").collect()]
    assert got == [(1, 0, 60)]


def test_bands_recall_edited_paragraphs():
    draw, both, found = random.Random(11), 0, 0
    for _ in range(600):
        text = prose(draw, passages.LONG)
        a, b = (T.shingle_hashes(T.word_hashes(t)) for t in (text, edited(draw, text, 1)))
        if T.similarity(T.bag(a), T.bag(b)) >= 0.8:
            both += 1
            found += any(x[0] == y[0] for x, y in zip(passages.bands(a, np.zeros(1, int), len(a)), passages.bands(b, np.zeros(1, int), len(b)), strict=True))
    assert both > 300 and found >= 0.98 * both


def test_edited_passages_are_found(spark):
    draw = random.Random(12)
    clean = lambda n: " ".join(f"c{draw.randrange(10**8)}" for _ in range(n))
    rows = []
    for i in range(60):
        passage = clean(100).split()
        changed = [*passage[:49], "changed", *passage[50:]]
        rows += [(2 * i, f"{clean(30)} {' '.join(passage)} {clean(30)}"), (2 * i + 1, f"{clean(40)} {' '.join(changed)} {clean(20)}")]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT kept").collect()
    assert all(d.doc_id % 2 for d in got)
    covered = {d: sum(g.n_words for g in got if g.doc_id == d) for d in range(1, 120, 2)}
    assert sum(n >= 99 for n in covered.values()) >= 48


def test_bags_of_many_texts():
    """Bags of texts together are those of each alone."""
    draw = random.Random(4)
    words = ["a", "b", "ΑΣ", "é", "z" * 14, "q" * 80, "İ"]
    for _ in range(50):
        texts = ["".join(draw.choice(words) + draw.choice([" ", ", ", "\n", ""]) for _ in range(draw.choice([0, 1, 4, 5, 6, 40]))) for _ in range(draw.randint(0, 9))]
        for t, got in zip(texts, T.text_bags(texts), strict=True):
            assert np.array_equal(got, T.text_bag(t))


def test_candidates_share_enough_of_their_prefixes(spark, monkeypatch):
    """Texts that share one rare run and nothing else are not compared; those that are alike are found, each pair once."""
    draw, seen = random.Random(2), []
    fresh = iter(range(10**6))
    new = lambda n: " ".join(f"u{next(fresh)}" for _ in range(n))
    run = [new(5) for _ in range(30)]
    base = [f"{r} {new(45)}" for r in run]
    texts = [*base, *[f"{r} {new(45)}" for r in run], *[" ".join(b.split()[:-2] + ["x", "y"]) for b in base]]
    ids = spark.createDataFrame([(i, i) for i in range(len(texts))], "id long, component long")
    had = near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, t: seen.append(sorted(map(tuple, pairs.select("a", "b").collect()))) or had(pairs, t))
    found = near.across(ids, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.8, near._differ)
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if T.similarity(T.text_bag(texts[a]), T.text_bag(texts[b])) >= 0.8]
    assert len(alike) >= 30 and sorted((r.a, r.b) for r in found.where("sim >= 0.8").collect()) == alike
    assert len(seen[0]) == len(set(seen[0])) < len(alike) + 30


def test_large_groups_make_few_rows_across_classes(spark, monkeypatch):
    """Texts of one group that are not alike, each a class of its own, hardly meet, though they share many tokens."""
    draw, made = random.Random(31), []
    text = prose(draw, 150)
    texts = [edited(draw, text, 6) for _ in range(150)]
    bags = [T.text_bag(t) for t in texts]
    want = {(a, b) for a in range(150) for b in range(a) if T.similarity(bags[a], bags[b]) >= 0.8}
    ids = spark.createDataFrame([(i, i) for i in range(150)], "id long, component long")
    had = near.written

    def written(df, name):
        if name == "candidates":
            plan = df._jdf.queryExecution().optimizedPlan()
            joins = [n for n in str(plan.toString()).split("\n") if "Join Inner" in n]
            assert len(joins) == 1 and "band" in joins[0]
        out = had(df, name)
        made.extend([out.count()] if name == "candidates" else [])
        return out

    monkeypatch.setattr(near, "written", written)
    found = near.across(ids, spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.8, near._differ)
    assert {(r.a, r.b) for r in found.where("sim >= 0.8").collect()} == want
    assert made[0] <= 2 * len(want) + 150 < 150 * 149 // 2


def test_counts_take_one_shuffle(spark, monkeypatch):
    """An order's rows are computed and dealt once: no plan has the Python step twice."""
    plans, had = [], backoff.written
    monkeypatch.setattr(backoff, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or had(df, name))
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "b c")], DOCS.split(", lang")[0])
    assert backoff.scores(docs).count() == 3
    initial = [p.split("Initial Plan")[-1] for p in plans]
    assert len(initial) == 4 and all(p.count("FlatMapCoGroupsInPandas") == 1 for p in initial[:2])


def test_counts_of_many_chunks_go_in_parts(spark, monkeypatch):
    """No plan shuffles the texts or the n-grams of all chunks at once; the scores are the same."""
    made, had = [], backoff.written
    draw = random.Random(8)
    text = [" ".join(draw.choice("abcdefgh") for _ in range(draw.choice([0, 3, 9, 30]))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(text), (0, text[0]), (None, "a b c")], "doc_id long, text string")
    want = sorted(map(str, backoff.scores(docs).collect()))

    def written(df, name):
        made.append((name, (out := had(df, name)).count()))
        return out

    monkeypatch.setattr(backoff, "written", written)
    assert sorted(map(str, backoff.scores(docs, chunk_bytes=40).collect())) == want
    for name in ("rows", "words", "counts2", "counts3", "scores"):
        each = [n for x, n in made if x == name]
        assert len(each) >= backoff.PARTS and max(each) < sum(each)


def test_counts_have_a_row_a_chunk_and_bucket(spark, monkeypatch):
    """However many n-grams there are, rows are as many as chunks and buckets make."""
    made, had = {}, backoff.written

    def written(df, name, *folders):
        made[name] = (out := had(df, name, *folders)).count()
        return out

    monkeypatch.setattr(backoff, "written", written)
    draw = random.Random(3)
    docs = spark.createDataFrame([(i, prose(draw, 200)) for i in range(20)], "doc_id long, text string")
    chunks = sum(len(t.encode()) for _, t in docs.collect()) // 5000
    assert backoff.scores(docs, chunk_bytes=5000).count() == 20 and chunks == 3
    assert all(0 < made[name] <= chunks**2 for name in ("words", "counts2", "counts3"))


def test_packed_order_is_stable():
    """N-grams that differ in low bits only are told apart, and equal ones keep their order."""
    high = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64) << np.uint64(60)
    for gram in (high, high | np.arange(500, dtype=np.uint64) % np.uint64(7), high[:1], high[:0]):
        assert np.array_equal(backoff._sorted(gram), np.argsort(gram, kind="stable"))
