"""Each operator against a brute-force version, on small tables with nulls, blanks, long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marlstone.llm import chat, common, decontaminate, html_text, packing, quality, simhash, suffixes, token_files, toxicity, warc
from marlstone.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, fp long, bucket int, runs string, n_words int, w string, kept int, stratum string, score double"
WORDS = "alpha beta gamma delta été größer señor kappa 42 a,b x. Idiot thing THE of and to".split()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def texts(seed=3):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))
    shared, base = say(60), say(150)
    out = [None, "", "  \n\t ", "one", "one two", "one two three", base, base, base + " more", shared + " " + say(40), say(30) + "\n" + shared, say(3000), "x" * 199, "x" * 230, "é" * 150, "a \x00b. c <|endoftext|> d", "l1\nl1\n\nl1\nl2 #*$%&|<> l2", say(80) + "\n" + say(80)]
    words = base.split()
    for k in (5, 50, 100):
        words = [*words]
        words[k] = "changed"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id here"), (7, texts()[7]), (7, "another text with the same id")]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, 1, 2, "r", 3, "w", 0, "s", 0.5) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_stored_tables_are_released(spark):
    import os

    before = common._kept[:]
    common._kept.clear()
    df = common.stored(spark.range(3).toDF("a"), "some")
    path = common._kept[0].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert common.release(spark) == 1 and not os.path.exists(path) and not common._kept
    common._kept.extend(before)


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path, out = vocabulary("byte_bpe_50k.json"), common.scratch_path(spark, "ids")
    got = token_files.read_token_files(token_files.write_token_files(docs, out, path), out).collect()
    tk = Tokenizer.from_file(path)
    ids = {}
    for i, t in pairs(docs):
        own = tk.encode(t, add_special_tokens=False).ids + [2]
        ids.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((i, *x) for i, v in ids.items() for x in v)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    out = common.scratch_path(spark, "ids")
    assert token_files.read_token_files(token_files.write_token_files(none, out, path), out).collect() == []


PIECES = ["a", "b", "The", "é", "İ", "ΑΣ", "\0", "\1", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff", ".", ",", ". ", ", ", "'s", "-", "_", "12", "²", "ﬁ", "中", "🙂", "#", '"', "x.y", "...", "</w>", "Ġ", "running"]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_are_the_librarys(name, kind):
    """Against a tokenizer of its own with the settings of its file: NUL, special tokens and every white space anywhere."""
    from tokenizers import Tokenizer

    u, tk, r = common.UnitTokenizer(vocabulary(name), kind, limit=500), Tokenizer.from_file(vocabulary(name)), random.Random(5)
    odd = ["a  b", " a", "a ", "\n\na b\n c", "it's 's ''s", "a　b", "É é", "a\tb\r\nc  d", "ΑΣ ΑΣ.", "é. b", "ab.. cd", "x_. y", ". a", '"a". b', "a\x00b. c", "1. 2, 3", "", " ", "\x85 a", "ab. cd, ef.\nGh", "İ. x"]
    odd += ["a \0b", "a \0. b", "a \0, b \0.", "a. \0. b, c", "\0. b", "a \0", "x  \0b \0. c", "a\n\0. b", "\t. b\tc d, e", "a b\t. c", "ab \t. cd", "say <|endoftext|> now"]
    odd += ["".join(r.choice(PIECES) + " " * (r.random() < 0.4) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for at in range(0, len(odd), 50):
        for t, e, w in zip(odd[at : at + 50], u.encode(odd[at : at + 50]), tk.encode_batch(odd[at : at + 50], add_special_tokens=False)):
            assert np.frombuffer(e, u.dtype).tolist() == w.ids, t
    for t in texts():
        assert np.frombuffer(u.encode([t or ""])[0], u.dtype).tolist() == tk.encode(t or "", add_special_tokens=False).ids
    plain = common.UnitTokenizer(vocabulary(name), kind, specials_as_text=True)
    assert len(plain.encode(["<|endoftext|>"])[0]) > plain.dtype.itemsize


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64).collect()
    want = []
    for i, t in pairs(docs):
        ids = tk.encode(t, add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert key(tuple(r)[:5] for r in got) == key(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) == len(best_fit([w[3] for w in want], 64))
    assert packing.pack(none, path).collect() == []


def best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        ok = [i for i, room in enumerate(bins) if room >= n]
        if ok:
            bins[min(ok, key=lambda i: bins[i])] -= n
        else:
            bins.append(size - n)
    return bins


def test_plan_is_best_fit_one_by_one():
    r = random.Random(5)
    for _ in range(60):
        size = r.choice([10, 17, 64])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 120))]
        counts = collections.Counter(lengths)
        plan = sorted(packing.best_fit_plan(counts, size))
        used = collections.Counter()
        for n, c in counts.items():
            runs = [p for p in plan if p[0] == n]
            for rank in range(c):
                p = [p for p in runs if p[1] <= rank][-1]
                used[p[2] + (rank - p[1]) // p[3]] += n
        assert sorted(size - x for x in used.values()) == sorted(best_fit(lengths, size))


def brute_simhash(t):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    h = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, threshold=2):
    least = {}
    for f in set(fps):
        if f in least:
            continue
        group, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for y in set(fps) - group:
                if bin(x ^ y).count("1") <= threshold:
                    group.add(y)
                    todo.append(y)
        own = [i for i, y in zip(ids, fps) if y in group and i is not None]
        least.update(dict.fromkeys(group, min(own, default=None)))
    return least


def test_simhash(docs, none):
    rows = pairs(docs)
    fps = [brute_simhash(t) for _, t in rows]
    least = brute_components([i for i, _ in rows], fps)
    got = key((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == key((i, f"{f:016x}", least[f]) for (i, _), f in zip(rows, fps))
    assert simhash.near_duplicates(none).collect() == []


def test_anchor_links(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = [int(b) for b in base] + [0, (1 << 64) - 1]
    for b in base:
        for _ in range(4):
            x = int(b)
            for k in r.integers(0, 64, int(r.integers(1, 5))):
                x ^= 1 << int(k)
            fp.append(x)
            fp.append(x ^ (1 << int(r.integers(0, 64))))
    fp = list(set(fp))
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from marlstone.llm.components import components

    root = {r.node: r.root for r in components(edges).collect()}
    groups = collections.defaultdict(set)
    for x, s in zip(fp, signed):
        groups[root.get(s, s)].add(x)
    least = brute_components(fp, fp)
    want = collections.defaultdict(set)
    for x in fp:
        want[least[x]].add(x)
    assert key(map(sorted, groups.values())) == key(map(sorted, want.values()))


def test_rounds_of_few_edges_are_few_files(spark, monkeypatch):
    import glob

    from marlstone.llm import components

    chain = [(i, i + 1) for i in range(1, 90)] + [(200, 300), (300, 250)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for each, most in ((components.EDGES, 1), (16, 12)):
        monkeypatch.setattr(components, "EDGES", each)
        kept = len(common._kept)
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            got = components.components(spark.createDataFrame(chain, "u long, v long")).collect()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        assert key(map(tuple, got)) == key([(i, 1) for i in range(1, 91)] + [(i, 200) for i in (200, 250, 300)])
        files = [len(glob.glob(f"{p.removeprefix('file://')}/part-*")) for p in common._kept[kept:]]
        assert len(files) > 2 and all(n <= most for n in files[1:]) and (most == 1 or max(files[1:]) > 1)


def test_code_covers_with_radius_one():
    x = np.random.default_rng(2).integers(0, 1 << 64, 500, dtype=np.uint64)
    row, a = simhash.anchors(x)
    d = np.bitwise_count(a ^ x[row])
    assert d.max() <= 2
    assert all(d[row == i].min() <= 1 for i in range(len(x)))
    assert len(np.unique(np.stack([row.astype(np.uint64), a]), axis=1).T) == len(row)


def brute_spans(rows):
    raw = [t.encode() for t in rows]
    c = collections.Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        cover = bytearray(len(t))
        for i in range(len(t) - 199):
            if c[t[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        out.append((len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, y in zip(t, cover) if not y)).hexdigest()))
    return out


def test_suffixes(docs, none, monkeypatch):
    rows = pairs(docs)
    want = key((i, *w) for (i, _), w in zip(rows, brute_spans([t for _, t in rows])))
    assert key(map(tuple, suffixes.removed(docs).collect())) == want
    assert suffixes.removed(none).collect() == []
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_suffixes_hot_and_split(spark):
    r = random.Random(9)
    core = "".join(r.choice("abcdef ") for _ in range(260))
    noise = lambda n: "".join(r.choice("uvwxyz ") for _ in range(n))
    rows = [(k, noise(r.randint(0, 150)) + core + noise(r.randint(0, 150))) for k in range(60)] + [(100 + k, core * 2) for k in range(30)] + [(200, "é" * 400), (201, "q" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = key((i, *w) for (i, _), w in zip(rows, brute_spans([t for _, t in rows])))
    assert key(map(tuple, suffixes.removed(df).collect())) == want


@pytest.mark.parametrize("split,local", [(3, 2), (3, 1000), (1000, 2), (0, 0)])
def test_suffixes_of_split_anchors(spark, monkeypatch, split, local):
    """Anchors with many contexts, found over all texts or in one task: no more than ``split`` of one meet in a task."""
    r = random.Random(10)
    core = "".join(r.choice("abcdef ") for _ in range(230))
    noise = lambda n: "".join(r.choice("uvwxyz ") for _ in range(n))
    rows = [(k, noise(r.randint(40, 150)) + core + noise(r.randint(40, 150))) for k in range(60)] + [(5, noise(60) + core), (None, core + noise(60)), (300, noise(400))]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (7, rows[7][1]), (400, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    verify = suffixes._verify

    def bounded(batches):
        met = collections.Counter()
        for b in batches:
            met.update(b.column(0).to_pylist())
            assert not met or max(met.values()) <= max(split, 1)
            yield from verify(iter([b]))

    monkeypatch.setattr(suffixes, "SPLIT", split)
    monkeypatch.setattr(suffixes, "LOCAL", local)
    monkeypatch.setattr(suffixes, "_verify", bounded)
    monkeypatch.setattr(suffixes, "_anchors", lambda batches, f=suffixes._anchors: (setattr(suffixes, "LOCAL", local), (yield from f(batches)))[1])
    want = key((i, *w) for (i, _), w in zip(rows, brute_spans([t for _, t in rows])))
    assert key(map(tuple, suffixes.removed(df).collect())) == want
    assert any(w[2] for w in want)


def test_dealt_rows_of_large_groups(spark):
    """The joins of split anchors return a row for each shared piece, not for each window, and twice as many for twice the group."""
    r = random.Random(12)
    core = "".join(r.choice("abcdef ") for _ in range(700))
    noise = lambda n: "".join(r.choice("uvwxyz ") for _ in range(n))
    ts = [(noise(r.randint(40, 150)) + core + noise(r.randint(40, 150))).encode() for _ in range(80)] + [core.encode() * 2, noise(500).encode()]
    made = []
    for some in (ts[40:], ts):
        runs = collections.defaultdict(list)
        for row, first, last, _, h, _ in zip(*suffixes.anchor_runs(some)):
            runs[int(row)].append((int(first), int(last), 2, int(h.view(np.int64))))
        df = spark.createDataFrame([(k, 0, some[k].decode(), False, x) for k, x in runs.items()], "own1 long, own2 long, text string, twice boolean, runs array<struct<first:int,last:int,kind:int,anchor:long>>")
        got = suffixes._dealt(common.map_arrow(df, suffixes._contexts, suffixes.CONTEXT).filter("windows = 0")).collect()
        c = collections.Counter(t[i : i + 200] for t in some for i in range(len(t) - 199))
        want = [(k, i) for k, t in enumerate(some) for i in range(len(t) - 199) if c[t[i : i + 200]] > 1]
        assert sorted((x.own1, i) for x in got for i in range(x["first"], x["last"] + 1)) == want
        assert len(got) < len(want) / 4
        made.append(len(got))
    assert made[1] < 2.5 * made[0]


def test_suffixes_compare_bytes_not_hashes(monkeypatch):
    """With a hash that says all runs are equal nothing is settled that is not."""
    r = random.Random(11)
    a, b = ("".join(r.choice("abcd") for _ in range(900)).encode() for _ in range(2))
    runs = suffixes.anchor_runs

    def blind(texts):
        row, first, last, at, h, c = runs(texts)
        return row, first, last, at, np.zeros_like(h), np.zeros_like(c)

    monkeypatch.setattr(suffixes, "anchor_runs", blind)
    own = np.arange(3)
    got = suffixes._collapsed([a, b, a], own, own).to_pydict()
    settled = collections.defaultdict(set)
    for o, p in zip(got["own1"], got["place"]):
        if p >= 0 and p & 255 == suffixes.SETTLED:
            settled[o].update(range(p >> 16, (p >> 16) + (p >> 8 & 255) + 1))
    assert not settled[1] and settled[0] == settled[2] != set()


def test_suffix_sort():
    r = random.Random(4)
    for alphabet in (b"ab", b"abc", b"a", bytes(range(256))):
        for _ in range(100):
            d = bytes(r.choice(alphabet) for _ in range(r.randint(1, 50)))
            order = suffixes.suffix_array(d, [(0, len(d), len(d))])
            assert order == sorted(range(len(d)), key=lambda i: d[i:])
            shared = [next((k for k in range(200) if a + k >= len(d) or b + k >= len(d) or d[a + k] != d[b + k]), 200) for a, b in zip(order, order[1:])]
            assert suffixes.common_prefixes(d, np.array(order)).tolist() == shared


def test_long_text_in_pieces(monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(suffixes, "CHUNK", 1200)
    a = bytes(r.choice(b"abcd") for _ in range(5000))
    b = a[700:3300] + b"-" + a[100:400]
    found = collections.defaultdict(list)
    for row, first, last, at, h, c in zip(*suffixes.anchor_runs([a, b])):
        found[h].append((row, first, last))
    out = [set(), set()]
    for rs in found.values():
        for (row, first, _), starts in zip(rs, suffixes.repeated_starts([[a, b][r][f : z + 200] for r, f, z in rs], [int(z - f + 1) for _, f, z in rs])):
            out[row].update(int(first) + i for i in starts)
    c = collections.Counter(t[i : i + 200] for t in (a, b) for i in range(len(t) - 199))
    assert out == [{i for i in range(len(t) - 199) if c[t[i : i + 200]] > 1} for t in (a, b)]


def test_toxicity(spark, docs, none):
    r = random.Random(6)
    bad = ["grobnik", "vorlash", "schtumpf"]
    rows = []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "en", "s", "."])
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {x.doc_id: x for x in toxicity.score(df.drop("toxic"), model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == t and got[i].predicted == int(got[i].score >= 0.5) for i, _, t in rows if got[i].held_out)
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.filter("text is null or not text like '%grob%'").count()
    assert toxicity.score(none, model).collect() == []
    nothing = toxicity.train(df, labels.limit(0))
    assert {x.score for x in toxicity.score(df, nothing).collect()} == {1 / (1 + np.exp(500.0))}


def brute_hash(gram):
    """An n-gram's hash, one byte at a time in plain integers."""
    m, h = (1 << 64) - 1, 0
    for i, x in enumerate(gram):
        h = ((h * int(toxicity._STEP) if i else 0) + int(toxicity._BYTE[x])) & m
    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & m
    return h ^ h >> 32


def test_toxicity_scores_by_brute_force():
    r = random.Random(7)
    rows = [(" ".join(r.choice(WORDS) + (r.choice(["", " grobnik", " Vorlash"]) if i % 3 == 0 else "") for _ in range(r.randint(1, 60))).encode(), int(i % 3 == 0)) for i in range(150)]
    for sizes in ((5, 7, 9), (3, 4)):
        model = toxicity.fit([t for t, _ in rows], [y for _, y in rows], sizes=sizes)
        weight = dict(zip(map(int, model.hashes), model.weights))
        assert weight
        some = [t for t, _ in rows[:40]] + [b"", b"x", "É grobnik\ngrobnik".encode(), b"grobnik " * 3000]
        for t, got in zip(some, model.scores(some)):
            own = b"\n" + t.lower() + b"\n"
            grams = {brute_hash(own[i : i + n]) for n in sizes for i in range(len(own) - n + 1)}
            assert got == pytest.approx(1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(g, 0.0) for g in grams), -500, 500))))


def test_toxicity_learns_one_row_of_an_id(spark):
    r = random.Random(8)
    rows = [(i, f"{'grobnik' if i % 2 else 'alpha'} {r.random()}") for i in range(60)]
    df = spark.createDataFrame(rows + [(1, "aaa least of its id")] + [(3, "zzz")] * 50, "doc_id long, text string")
    texts_, y = toxicity.training_rows(df, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    want = sorted((i, t) for i, t in {**dict(rows), 1: "aaa least of its id"}.items() if zlib.crc32(str(i).encode()) % 5)
    assert texts_ == [t.encode() for _, t in want] and y == [i % 2 for i, _ in want]
    assert toxicity.cross_validated(texts_ * 3, y * 3, [{}])[0][0] > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="page"><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><div class="cookie-notice">We use cookies, as all do.</div>
{open}<h1>A  title &amp; more</h1><p>First paragraph, with <b>bold</b> and <a href="/x">a link</a>.<p>Second: caf&eacute;&nbsp;&#233; &lt;b&gt;, longer than the first one is.</p>
<ul><li>one item, here</li><li>another item, there</li></ul><div class="ad">Buy now, cheap!</div><form><input><button>Send</button></form>{close}
<div id="comments"><p>Nice one, thanks a lot for this long and thoughtful article!</p></div><aside>Related things, and so on.</aside><footer>&copy; all rights, reserved.</footer></body></html>"""
TEXT = "A title & more\nFirst paragraph, with bold and a link.\nSecond: café é <b>, longer than the first one is.\none item, here\nanother item, there"


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="story">', "</div>"), ("<ARTICLE>", "</ARTICLE>")])
def test_html(tags):
    assert html_text.main_text(PAGE.format(open=tags[0], close=tags[1])) == TEXT


@pytest.mark.parametrize("tags", [('<div class="content has-sidebar">', "</div>"), ('<form id="aspnetForm"><div class="no-sidebar with-nav">', "</div></form>"), ('<fieldset class="story">', "</fieldset>")])
def test_html_page_in_a_named_wrapper(tags):
    assert html_text.main_text(PAGE.format(open=tags[0], close=tags[1])) == TEXT


def test_html_story_beside_cards():
    story = "".join(f"<p>Paragraph {i} of the story, which goes on, and on, for a while.</p>" for i in range(8))
    got = html_text.main_text(f'<body><div class="story"><h1>Story</h1>{story}</div><article class="card"><p>A card, short.</p></article></body>')
    assert all(f"Paragraph {i} of" in got for i in range(8))
    parts = "".join(f'<div class="widget"><p>Part {i} of the text, in a widget of its own.</p></div>' for i in range(5))
    assert all(f"Part {i} of" in html_text.main_text(f"<body>{parts}</body>") for i in range(5))
    assert all(f"Paragraph {i} of" in html_text.main_text(f'<body><div><h1>Site</h1></div><div class="with-nav">{story}</div></body>') for i in range(8))
    comments = "<p>Comment, rather long, of someone who has read the article.</p>" * 20
    assert html_text.main_text(f'<body><div><h1>T</h1><p>Short article, of one line.</p></div><div id="comments">{comments}</div></body>') == "T\nShort article, of one line."


def plain_pages(seed):
    """Generated pages without article or main, names or roles: only text and punctuation tell the story apart."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() + r.choice([",", ".", "", "", ""]) for _ in range(n))
    menu = lambda n: "<div>" + "".join(f"<div><a href='/{word()}'>{word()}</a> {word()}</div>" for _ in range(n)) + "</div>"
    story = [say(r.randint(20, 60)) for _ in range(r.randint(3, 9))]
    body = "".join(f"<p>{p}</p>" for p in story)
    return f"<html><body>{menu(r.randint(60, 99))}<div><div>{body}</div></div>{menu(r.randint(60, 99))}<table><tr><td>{word()}</td></tr></table></body></html>", "\n".join(" ".join(p.split()) for p in story)


def brute_scores(page):
    """Path scores with the library's parser: whole paths, a loop for each ratio."""
    from html.parser import HTMLParser

    nodes, stack = [], []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            self.flush()
            stack.append(tag)

        def handle_endtag(self, tag):
            if tag != "a":
                self.flush()
            stack.pop()

        def handle_data(self, data):
            self.held = getattr(self, "held", "") + data
            self.linked = getattr(self, "linked", 0) + (len(data.strip()) if "a" in stack else 0)

        def flush(self):
            text = " ".join(getattr(self, "held", "").split())
            if text and stack[-1] != "a":
                nodes.append((tuple(stack), len(text) - self.linked, len(re.findall(r"[.,]", text))))
            if stack and stack[-1] != "a":
                self.held, self.linked = "", 0

    Parser().feed(page)
    out = []
    for i, (path, _, _) in enumerate(nodes):
        best = 0.0
        for j, (other, _, _) in enumerate(nodes):
            if other == path:
                fused = []
                for f in (1, 2):
                    mean = []
                    for k in (max(j - 1, 0), j, j, min(j + 1, len(nodes) - 1)):
                        same = [x[f] for x in nodes if x[0] == nodes[k][0]]
                        mean.append(sum(same) / len(same))
                    fused.append(sum(mean) / 4)
                best = max(best, fused[0] * (1 + fused[1]))
        total = sum(x[1] for x in nodes if x[0] == path)
        out.append(best * total / (total + 40))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_html_paths_choose(seed):
    page, story = plain_pages(seed)
    found = html_text.blocks(page)
    elements = html_text._elements(found)
    plain = html_text.path_scores(found, [1.0] * (elements[-1].id + 1))
    assert plain == pytest.approx(brute_scores(page))
    assert html_text.main_text(page) == story
    # without the ratios the menus stay
    assert "\n".join(b.text for b in html_text.content(found, share=0.0)) != story


@pytest.mark.parametrize("unit", ["<div>x ", "<a ", "<a b='", "<p><b>x", "<div></p>", "<td>x</td>", "</div>", "<!-", "<script", "<svg>", "<x/", "<li>y<ul>", "&amp", "<a =\"'>", "<h1>a<table>", "<textarea/>", "<iframe/>"])
def test_html_takes_linear_time(unit):
    import time

    began = time.process_time()
    html_text.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 20


def test_html_title_beside_the_story():
    story = "".join(f"<p>Paragraph {i} of the story, which goes on, and on, for a while.</p>" for i in range(8))
    want = "Title\n" + "\n".join(f"Paragraph {i} of the story, which goes on, and on, for a while." for i in range(8))
    assert html_text.main_text(f"<body><div><div><h1>Title</h1></div><div>{story}</div></div><div>Imprint</div></body>") == want
    assert html_text.main_text(f"<body><div><a>x</a></div><h1>Title</h1><div>{story}</div><div>Imprint</div></body>") == want
    assert html_text.main_text(f"<article><header><h1>Title</h1><p>By someone</p></header><div>{story}</div><p hidden>Not shown.</p></article>") == want


def test_html_table(spark):
    rows = [(1, "u", PAGE.format(open="<article>", close="</article>")), (2, None, None), (3, "v", ""), (None, "w", "plain text only."), (4, "x", "<p>unclosed <b>bold<p>and more, of it."), (1, "u", "<nav><a>menu</a></nav>"), (5, "y", "<script>" * 3), (6, "z", "<article>" + "<p>long text, here.</p>" * 5000 + "</article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.text) for r in got][:7] == [(1, TEXT), (2, ""), (3, ""), (None, "plain text only."), (4, "unclosed bold\nand more, of it."), (1, ""), (5, "")]
    assert got[7].text == "\n".join(["long text, here."] * 5000) and got[7].n_chars == len(got[7].text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc(spark):
    same, short = "<p>" + "same é " * 40, "tiny"
    rows = [(5, "http://a/ b", same), (3, None, same), (9, "u", same), (1, "u", short), (2, "u", short), (4, "u", None), (None, "u", same), (3, "u", same), (6, "u", "x" * 300_000), (7, "u\r\nX: 1", "\r\n\r\n" * 30)]
    rows += [(100 + k, "u", f"<html>page {k} " + "word " * (k % 50)) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = common.scratch_path(spark, "warc")
    got = key(map(tuple, warc.read_archives(warc.write_archives(df, out)).collect()))
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    count = collections.Counter(h for _, _, h in rows)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        refers = first[h] if h in first and count[h] > 1 and i != first[h] else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == key(want)
    none = common.scratch_path(spark, "warc")
    assert warc.read_archives(warc.write_archives(df.limit(0), none)).collect() == []


def test_warc_validates():
    record = warc._record(1, "u", b"x" * 200, 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    assert warc.parse(record)[0] == 1
    for broken in (record[:-5], record.replace(b"xxx", b"xxy", 1), record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 200", b"Content-Length: 201"), record.replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(ValueError):
            warc.parse(broken)


def test_chat(spark):
    c = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a"], 5: ["x"], 6: ["x", None], 7: ["x", ""], None: ["n", "m"], 8: ["ab"], 9: ["a", "b", "d"]}
    rows = [(i, k, None if k == 9 else "user" if k % 2 == 0 else "assistant", t) for i, turns in c.items() for k, t in enumerate(turns)]
    r = random.Random(1)
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "p") for x in rows], "conv_id long, turn long, role string, text string, prefix string")
    got = {x.conv_id: x for x in chat.collapse(df).collect()}
    seqs = {i: tuple(t or "" for t in v) for i, v in c.items()}
    keep = {i for i, s in seqs.items() if not any(o[: len(s)] == s and (len(o) > len(s) or (j is not None and (i is None or j < i))) for j, o in seqs.items() if j != i)}
    assert set(got) == keep
    assert got[2].text == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n<|end|>\n" and got[2].n_turns == 3
    assert chat.collapse(df.limit(0)).collect() == []


def brute_windows(rows, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    wins = collections.defaultdict(set)
    for i, t in items:
        w = find(low(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])] |= {i} - {None}
    out = []
    for i, t in rows:
        w, hit, its = find(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    its |= wins[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(map(str, its))).encode()).hexdigest(), bool(hit)))
    return key(out)


def test_decontamination(spark, docs, none):
    t = texts()
    items = [(1, " ".join(t[6].split()[3:30])), (2, t[6].upper()), (12, "one"), (7, "one two"), (3, "ONE, two-three"), (4, None), (5, "..."), (None, " ".join(t[9].split()[:12])), (1, "never seen words in any of the documents at all here"), (9, " ".join(t[11].split()[2000:2015]))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, tok long")
    got = decontaminate.report(docs, bench)
    assert key(map(tuple, got.collect())) == brute_windows(pairs(docs), items)
    assert decontaminate.report(none, bench).collect() == []
    assert all(r.n_hit == 0 and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in decontaminate.report(docs, bench.limit(0)).collect())
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == got.filter("not contaminated").count()
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_of_shared_items(spark, monkeypatch):
    """One-word items, an item that a thousand ids share, repeated and null ids, and shingles looked up by a shuffle."""
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = say(14)
    items = [(i, shared) for i in range(1000)] + [(2000, "kappa"), (2001, "of and"), (2002, say(40)), (None, "alpha"), (2003, None)]
    rows = [(i % 7 if i % 5 else None, say(r.randint(0, 60)) + (" " + shared if i % 3 == 0 else "")) for i in range(60)] + [(1, "kappa"), (1, "kappa"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows([(i, t or "") for i, t in rows], items)
    assert key(map(tuple, decontaminate.report(docs, bench).collect())) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert key(map(tuple, decontaminate.report(docs, bench).collect())) == want
    assert decontaminate.clean(docs, bench).count() == sum(not x[-1] for x in want)


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    cover = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels)
    want = [(i, *(m := brute_measures(t)), (b := m[0] < 50 or 100 * m[4] > 50 * m[0]), not b) for i, t in pairs(docs)]
    assert key(map(tuple, got.collect())) == key(want)
    assert quality.judge(none, labels).collect() == [] and not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def binomial_cdf(k, n, p):
    from fractions import Fraction
    from math import comb

    p = Fraction(p).limit_denominator(10**6)
    return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("n_rows,want", [(2400, {"en": {"symbols": 0.3}}), (1600, {})])
def test_quality_cutoffs(spark, n_rows, want):
    """Of 3/8 of the rows, the good ones of a stratum, none is rejected; 0.99 ** n must be 0.05 / 90 or less, so 746 are needed."""
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n_rows):
        lang = "en" if i % 2 else "xx"
        bad = i % 8 < 2
        symbols = r.choice([0.0, 0.01]) if not bad or lang == "xx" else 0.4
        n = 200
        rows.append((i, lang, n, n * 5, int(symbols * n), 0, 0, 10, False))
        labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    got = {x.stratum: x.limits for x in quality.cutoffs(df, spark.createDataFrame(labels, "doc_id long, quality int"), "lang").collect()}
    assert got == want


@pytest.mark.parametrize("k,n", [(0, 300), (1, 300), (3, 1200), (5, 1200), (0, 900), (2, 700)])
def test_binomial_bound_is_exact(spark, k, n):
    from pyspark.sql import functions as F

    level = 1e-3
    got = spark.range(1).select(quality._within(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), 0.01, F.log(F.lit(level)))).first()[0]
    assert got == (k < n * 0.01 and binomial_cdf(k, n, 0.01) <= level)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))
    passage, item = say(70), say(30)
    rows = [(i, say(120), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, rows[0][1], "en", "s", 1) for i in range(5)]
    rows += [(300 + i, say(60) + " " + passage + " " + say(60), "fr", None, 1) for i in range(4)]
    rows += [(400, say(50) + " " + item, "en", "s", 1), (401, None, None, None, None), (402, "", "en", "s", 0)]
    rows += [(500 + i, say(60) + " vorlash grobnik " + say(20), "en", "s", 1) for i in range(80)]
    odd = [(None, say(90), "en", "s", 1), (None, say(90), "en", "s", 1), (3, say(90), "en", "s", 1), (None, say(40) + " " + " ".join(item.split()[:14]), "en", "s", 1), (3, say(40) + " " + passage, None, "s", 1)]
    rows += odd
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 500)) for i, *_ in rows if i is not None and (i < 120 or i >= 500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
    own = {n: collections.Counter((x.doc_id, x.text) for x in d.collect() if x.doc_id in (None, 3)) for n, d in seen.items() if n != "packing"}
    whole = collections.Counter((i, t) for i, t, *_ in rows if i in (None, 3))
    assert own["toxicity"] == own["simhash"] == whole
    # of the repeated and null ids one text loses the passage, another goes with its benchmark window
    assert sum((own["suffixes"] & whole).values()) == sum(whole.values()) - 1 == sum(own["decontamination"].values())
    assert (None, odd[3][1]) not in own["decontamination"] and sum(x.doc_id is None for x in docs.collect()) == 2
    ids = {n: {x.doc_id for x in d.collect()} - {None} for n, d in seen.items()}
    assert ids["toxicity"] == {i for i, *_ in rows if i is not None and i < 500}
    assert ids["simhash"] == ids["toxicity"] - set(range(200, 205)) - {402}
    assert ids["suffixes"] == ids["simhash"] and ids["decontamination"] == ids["suffixes"] - {400}
    cut = {x.doc_id: x.text for x in seen["suffixes"].collect()}
    assert all(passage[20:-20] not in cut[300 + i] for i in range(4)) and cut[5] == rows[5][1]
    assert ids["packing"] == ids["decontamination"] and [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    assert all(seen[n].columns == schema.replace(" long", "").replace(" string", "").split(", ") for n in list(seen)[:-1])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()), key=repr) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()), key=repr)


def test_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    r = random.Random(14)
    t = [" ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(8)]
    rows = [(None, t[0]), (None, t[0]), (None, t[1]), (None, t[2]), (3, t[2]), (7, t[3]), (7, t[4]), (2, t[4]), (7, t[5]), (7, t[5]), (9, t[6]), (9, t[7]), (11, None), (None, "")]
    df = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns
    want = [(None, t[0]), (None, t[1]), (3, t[2]), (7, t[3]), (2, t[4]), (7, t[5]), (9, t[6]), (9, t[7]), (11, None)]
    assert key((x.doc_id, x.text) for x in got.collect()) == key(want)
