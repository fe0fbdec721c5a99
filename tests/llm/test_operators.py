"""Each training-data operator on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmill.llm import classifier, embeddings, entries, html_text, mixing, packing, rules, sharding, simhash, token_files, warc
from docmill.llm.common import components, fresh, running_sum, table, written
from docmill.llm.tokens import CachedEncoder, family

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is that ferry garden stone river light morning paper window quiet letter music".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents; columns whose names clash with those that the operators make."""
    rng = random.Random(1)
    base = prose(rng, 300)
    rows = [(1, base), (2, base), (3, base + " stone"), (4, None), (5, ""), (6, " \n\t "), (7, prose(rng, 6000)), (8, "a b c"), (9, "ünï çødé 日本 " * 40), (10, base.upper()), (10, base.upper()), (None, "no id " * 30), (11, prose(rng, 90) + "\n" + "same line\n" * 5)]
    rows += [(100 + i, prose(rng, rng.randint(1, 200))) for i in range(40)]
    return written(spark.createDataFrame([(i, t, ["en", "fr", None, "xx"][k % 4], ["a", "b", None, "a"][k % 4], 7, "x", 1.5, 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, length string, score double, shard int"), "odd")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def none(df):
    return df.where("1 = 0")


def test_encoder():
    rng, alphabet = random.Random(3), "ab'sA É\n\t   1²é.,!ſ́ΣσİI\x1c-#|\x00\u180e\xa0日"
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        assert family(Tokenizer.from_file(public_tokenizers.path(name))) == name.split("_")[0]
        e, t = CachedEncoder(public_tokenizers.path(name), most=50_000), Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(3000):
            x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
            assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
        rng2 = random.Random(4)
        for x in ["a" * 5000 + " b", " " * 3000 + "x" + "\n" * 900, *[" ".join("".join(rng2.choices("etaoinshrdlu", k=rng2.randint(1, 12))) + rng2.choice(["", "", ",", ".\n"]) for _ in range(4000)) for _ in range(3)]]:
            assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:80]


def test_packing(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    want = Counter()
    for i, x in texts:
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack_documents(none(docs), path).count() == 0


def test_best_fit():
    rng = random.Random(5)
    for most in (1, 3, 64):
        b, used = packing.BestFit(100, most), Counter()
        for _ in range(2000):
            n = rng.randint(1, 100)
            i, at = b.place(n)
            assert at == used[i]
            used[i] += n
            assert used[i] <= 100 and b.open <= most
    assert sum(used.values()) / (100 * len(used)) > 0.93
    with pytest.raises(ValueError):
        packing.BestFit(10).place(11)


def test_token_files(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for kind in ("byte", "bit"):
        made = token_files.write_files(docs, path, fresh(spark, "t"), kind=kind, block=777, shard_bytes=4000)
        assert len(made) > 4
        got = sorted(token_files.read_files(spark, made).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
        at, want = 0, Counter()
        for i, x in texts:
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
            want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        for r in got:
            assert r.start == at
            at += r.n_tokens
    fs, where = pafs.FileSystem.from_uri(made[-1][0])
    with fs.open_input_file(where) as f:
        r = token_files.Reader(f)
        whole = np.concatenate([r.chunk(k) for k in range(len(r.index))])
        assert len(whole) == r.n_ids == made[-1][2] and (r.chunk(len(r.index) - 1) == whole[-int(r.index[-1, 1]) :]).all()
    assert token_files.read_files(spark, token_files.write_files(none(docs), path, fresh(spark, "t"))).count() == 0


def test_classifier(spark, docs):
    rng = random.Random(2)
    good, bad = [prose(rng, 80) for _ in range(120)], [" ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 80).split()) for _ in range(120)]
    d = spark.createDataFrame([(i, x, 9) for i, x in enumerate(good + bad)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(500, None), (None, 1)], "doc_id long, quality int")
    model = classifier.train(d, labels)
    out = {r.doc_id: r.score for r in classifier.score_documents(d, model, ["doc_id"]).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert 30 < len(held) < 70 and all((out[i] >= 0.5) == (i < 120) for i in held)
    assert {r.doc_id for r in classifier.accepted(d, model).collect()} == set(range(120))
    scored = classifier.score_documents(docs, model, ["doc_id"]).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert classifier.score_documents(none(docs), model, ["doc_id"]).count() == 0
    empty = classifier.train(docs, labels.where("1 = 0"))
    assert empty.bias == 0 and empty.scorer()("any text") == 0.5
    # the score is what the vectors say: margins averaged over the bag
    at, w = classifier.bag("some some text", n=1 << 16)
    z = model.bias + float(w @ model.margin[at])
    assert abs(model.scorer()("some some text") - 1 / (1 + np.exp(-z))) < 1e-6


def test_warc(spark, docs):
    p = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/ y\r\n").alias("url"), F.col("text").alias("html"), F.lit(1).alias("digest"))
    rows = p.collect()
    files = warc.write_archives(p, fresh(spark, "w"), frame_bytes=2000, bundle_bytes=3000)
    assert len(files) > 4
    got = warc.read_archives(spark, files).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.html or "").encode(), []).append(r.page_id)
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        mine = [r for r in got if r.payload_digest == digest]
        assert Counter(r.page_id for r in mine) == Counter(ids) and {r.payload_bytes for r in mine} == {len(payload)}
        top = max((i for i in ids if i is not None), default=None)
        assert [r.page_id for r in mine if r.record_type == "response"] == [top]
        assert all(r.refers_to == top for r in mine if r.record_type == "revisit")
    seen = []
    for file in files:
        fs, where = pafs.FileSystem.from_uri(file)
        with fs.open_input_file(where) as f:
            b = warc.BundleReader(f)
            for name, frame, offset, length in b.index():
                assert b.record(frame, offset, length)[0]["WARC-Record-ID"] == f"<{name}>"
                seen.append(name)
    assert len(set(seen)) == len(seen) == len(rows)
    assert warc.read_archives(spark, warc.write_archives(none(p), fresh(spark, "w"))).count() == 0


def brute_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", data) if x]
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs, texts):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(x) for _, x in texts]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        least[r] = min(least.get(r, 1 << 60), 1 << 60 if i is None else i)
    want = sorted((i is not None, i or 0, f"{f:016x}", None if least[r] == 1 << 60 else least[r]) for (i, _), f, r in zip(texts, fps, roots, strict=True))
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(none(docs)).count() == 0


def test_simhash_links_are_complete(spark, monkeypatch):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_components(fps)
    for m, split in ((3, 4096), (4, 4096), (3, 6)):
        monkeypatch.setattr(simhash, "THREE_BYTES_UP_TO", 10**9 if m == 3 else 0)
        monkeypatch.setattr(simhash, "SPLIT", split)
        roots = {r.node: r.root for r in components(simhash.fingerprint_links(df)).collect()}
        mine = [roots.get(f - (1 << 64) if f >> 63 else f, f) for f in fps]
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_html(spark):
    page = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
    <header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies, accept them please now.</p></div>
    <article><h1>The  title &amp; more</h1><p>First paragraph of the <b>article</b>&nbsp;text, with enough words to be one.<p>Second   paragraph,
    over lines, ends with &lt;tag&gt; and caf&eacute;.</p><form><input><p>Subscribe to our newsletter</p></form></article>
    <aside class="sidebar"><p>Related things to read elsewhere today.</p></aside><section id="comments"><div class="comment"><p>I liked this article a lot, thank you for writing it.</p></div></section>
    <footer>&copy; Site 2024</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain &lt; text"), (1, "u", page), (4, "u", "<p>cut off <b>page &am"), (5, "u", "<div " + "x" * 100)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract_pages(df).collect()
    assert got[0].text == "The title & more\nFirst paragraph of the article text, with enough words to be one.\nSecond paragraph, over lines, ends with <tag> and café."
    assert got[4] == got[0] and got[1].text == got[2].text == got[6].text == "" and got[0].n_chars == len(got[0].text)
    assert len(got) == 7 and html_text.extract_pages(none(df)).count() == 0


def test_html_unclosed():
    model = html_text.trained()
    for tag in ("svg", "object", "template", "canvas", "video"):
        page = f"<article><h1>A title of some words</h1><p>First paragraph of the article, with words enough.</p><{tag} class=x><path d=1><p>Second paragraph of the article, with words enough.</p><p>Third paragraph of the article, with words enough.</p></article>"
        assert html_text.extract(page, model).count("\n") == 3
        assert "hidden" not in html_text.extract(page.replace("<path", f"<i>hidden</i></{tag}><path"), model)


def test_html_model():
    model, right, n = html_text.trained(), 0, 0
    for html, _ in html_text.labelled_pages(60, seed=123):
        dom = html_text.parse(html)
        p = html_text.marginals(model, dom, model.unary(html_text.node_features(dom)))
        for i in {i for i, _ in dom.runs}:
            n, right = n + 1, right + ((p[i] >= 0.5) == ('data-c="1"' in dom.attrs[i]))
    assert right / n > 0.97


def test_html_marginals_are_exact():
    rng = random.Random(4)
    dom = html_text.parse("<div><p>a</p><p>b</p><ul><li>c<li>d</ul></div><p>e</p>")
    model = html_text.Model(edges=[[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)])
    unary = [rng.uniform(-2, 2) for _ in dom.tags]
    n, total, on = len(dom.tags), 0.0, [0.0] * len(dom.tags)
    for s in range(1 << n):
        bits = [s >> i & 1 for i in range(n)]
        w = np.exp(sum(u for u, b in zip(unary, bits, strict=True) if b) + sum(model.edges[dom.tags[i] in html_text.TEXT_TAGS][bits[dom.parents[i]]][bits[i]] for i in range(1, n)))
        total += w
        on = [a + w * b for a, b in zip(on, bits, strict=True)]
    assert np.allclose(html_text.marginals(model, dom, unary), np.array(on) / total)


def test_sharding(spark, docs, texts):
    got = sharding.shard_documents(docs, [1.0] * 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(x.encode()) + 16, zlib.crc32(x.encode())) for i, x in texts)
    for s in {r.shard for r in got}:
        mine = [r.slot for r in got if r.shard == s]
        assert sorted(mine) == list(range(len(mine)))
    assert all(r.grown_shard in (r.shard, 5) for r in got) and {r.law for r in got} == {"key"}
    def score(doc, shard):  # Spark's xxhash64 of several columns: each is hashed with the hash so far as seed
        h = xxhash.xxh64_intdigest(struct.pack("<i", 0), 42)
        h = h if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return -1 / math.log(((h >> 11) + 0.5) / (1 << 53))

    for r in got:
        assert r.shard == max(range(5), key=lambda k: (score(r.doc_id, k), k))
        assert r.grown_shard == max(range(6), key=lambda k: (score(r.doc_id, k), k))
    six = {r.doc_id: r.shard for r in sharding.shard_documents(docs, [1.0] * 6).collect()}
    assert all(six[r.doc_id] == r.grown_shard for r in got)
    wide = sharding.shard_rows(spark.range(20000), "id", [1.0, 2.0, 1.0]).groupBy("shard").count().collect()
    assert all(abs(r["count"] / 20000 - (0.5 if r.shard == 1 else 0.25)) < 0.02 for r in wide)
    assert sharding.shard_documents(none(docs), [1.0] * 3).count() == 0
    with pytest.raises(ValueError):
        sharding.best(F.lit(1), [1.0, 0.0])


def brute_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_rules(docs, texts):
    got = rules.verdicts(docs, ["doc_id"]).collect()
    assert Counter((r.k0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_counts(x)) for i, x in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert rules.kept_documents(none(docs)).count() == 0


def judged(spark, clean, junk):
    """Which of the clean and of the junk texts, all Spanish, are kept."""
    rows = [(i, x, "es") for i, x in enumerate(clean + junk)]
    got = {r.k0: r.kept for r in rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    return [got[i] for i in range(len(clean))], [got[i] for i in range(len(clean), len(rows))]


def spanish(rng, n):
    """As many words, a quarter of them common ones."""
    plain = [a + b + c for a in ("ca", "mon", "ti") for b in ("ra", "lle", "go") for c in ("do", "na", "sol")]
    return " ".join(rng.choice(rules.COMMON["es"].split()[:12]) if rng.random() < 0.25 else rng.choice(plain) for _ in range(n))


def test_rules_hot_junk(spark):
    rng = random.Random(5)
    clean = [spanish(rng, 300) for _ in range(60)]
    junk = [f"#{rng.randint(100, 999)}$ 4{rng.randint(10, 99)}|{i}" for i in range(114)]
    near = [" ".join([*junk[:k], f"{k}%", *junk[k + 1 :]]) for k in range(45)]
    for group in ([" ".join(junk)] * 90, near * 2, [" ".join(f"#{i}$ 4{i}|" for i in range(20_000))]):
        good, bad = judged(spark, clean, group)
        assert all(good) and not any(bad)


def test_rules_without_common_words(spark):
    rng = random.Random(6)
    clean = [spanish(rng, n) for n in (60, 80, 150, 300, 600) for _ in range(20)]
    listed = set(rules.WORDS)
    salad = [" ".join("".join(rng.choice("aeilmnorst") for _ in range(rng.randint(4, 9))) for _ in range(n)) for n in (50, 60, 100, 1000, 9000)]
    salad = [" ".join(w for w in x.split() if w not in listed) + " palabra" for x in salad]
    good, bad = judged(spark, clean, salad)
    assert all(good) and not any(bad)


def test_rules_against_brute_force(spark, docs):
    """The verdict anew: plain dictionaries and the definition of the divergence, over real documents and odd ones."""
    listed = {w for ws in (*rules.COMMON.values(), rules.MARKS) for w in ws.split()}

    def js(p, q):
        h = lambda a, b: sum(x * np.log2(x / ((x + b.get(k, 0)) / 2)) for k, x in a.items() if x > 0)
        return np.sqrt(max(0, (h(p, q) + h(q, p)) / 2))

    def words_of(lang):
        own = rules.COMMON[lang].split()
        z = sum(1 / (i + 2) for i in range(len(own)))
        p = {w: 0.42 / (i + 2) / z for i, w in enumerate(own)}
        return p | {None: 1 - sum(p.values())}

    def verdict(text, lang):
        n, *_, repeated = brute_counts(text)
        if n < 50 or 100 * repeated > 50 * n:
            return False
        kinds, seen = Counter(int(rules.class_table()[ord(c)]) for c in text), Counter(w if w in listed else None for w in re.split(r"[\x20\x09-\x0D]+", text) if w)
        ref = dict(enumerate(x / sum(rules.CLASS_SHARES) for x in rules.CLASS_SHARES))
        if lang not in rules.COMMON:
            fold = lambda d: Counter({k: sum(v for c, v in d.items() if (0 if c in (0, 1, 2, 4) else c) == k) for k in (0, 3, 5, 6, 7)})
            kinds, ref = fold(kinds), fold(ref)
        if len(text) >= 200 and js({k: v / len(text) for k, v in kinds.items()}, ref) > 0.18 + 0.5 / np.sqrt(n):
            return False
        if lang not in rules.COMMON:
            return True
        most = 0.98 * js({None: 1.0}, words_of(lang))
        limit = min(0.42 + 0.5 / np.sqrt(n), most) if n >= 100 else most
        return min(js({k: v / n for k, v in seen.items()}, words_of(x)) for x in rules.COMMON) < limit

    sample = table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(docs.select(F.col("doc_id") + 10_000_000, "text", "lang").toDF("doc_id", "text", "lang"))
    texts = {r.doc_id: (r.text or "", r.lang) for r in sample.collect()}
    got = {r.k0: r.kept for r in rules.verdicts(sample, ["doc_id"]).collect()}
    assert {i: verdict(*x) for i, x in texts.items() if i is not None} == {i: k for i, k in got.items() if i is not None}
    assert 20 < sum(got.values()) < len(got)


def test_rules_alone(spark):
    """Junk is dropped whatever stands beside it, even if nothing does; a verdict does not depend on other rows."""
    rng = random.Random(7)
    junk = [" ".join(f"#{rng.randint(100, 999)}$ 4{rng.randint(10, 99)}|{i}" for i in range(114)) for _ in range(40)]
    for lang in ("es", "xx"):
        df = spark.createDataFrame([(i, x, lang) for i, x in enumerate(junk)], "doc_id long, text string, lang string")
        assert rules.kept_documents(df).count() == 0


def test_distance():
    got = [rules.distance(np.array(p), np.array(q)) for p, q in (([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.8, 0.2], [0.3, 0.7]))]
    m = np.array([0.55, 0.45])
    want = np.sqrt(sum((np.array(p) * np.log2(np.array(p) / m)).sum() for p in ([0.8, 0.2], [0.3, 0.7])) / 2)
    assert got[0] == 1 and got[1] == 0 and abs(got[2] - want) < 1e-12


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal((30, 16))
    x = np.vstack([c[rng.integers(0, 12, 150)] + 0.12 * rng.standard_normal((150, 16)), c, c[:5], c[:3] * 2]).astype("float32")
    rows = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)]
    odd = [(900, None, "e"), (901, [0.0] * 16, "e"), (902, [float("nan")] * 16, "e"), (903, [None, 1.0] * 8, "e"), (904, [], "e"), (None, rows[0][1], "e"), (905, [1.0, 2.0], "e")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    y = np.vstack([y, y[:1]])  # the row without id
    s = y @ y.T >= 0.9
    np.fill_diagonal(s, False)
    found, true = sum(got[i].n_links for i in range(len(rows))), int(s[: len(rows)].sum())
    assert 0.95 * true <= found <= true
    assert all(got[i].n_links <= s[i].sum() for i in range(len(rows)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert got[None].component_id is None and all(got[i].component_id <= i for i in range(len(rows)))
    assert embeddings.near_duplicates(none(df)).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.7])
def test_tables_with_a_common_direction(mean):
    rng = np.random.default_rng(8)

    def draw(n):
        x = rng.standard_normal((n, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(1 - mean)

    x = draw(2000)
    x[:, 0] += np.sqrt(mean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = embeddings.Tables(x[:1000], 20)
    y = embeddings.threshold_pairs(x[1000:], draw(1000))
    assert (tables.keys(x[1000:]) == tables.keys(y)).any(axis=1).mean() >= 0.9


def test_embeddings_exact_when_no_table_does(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_TABLES", 1)
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((200, 16)) + 2.0).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = y @ y.T >= 0.9
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == dict(enumerate((s.sum(axis=1) - 1).tolist()))
    least = np.arange(len(x))
    for _ in range(len(x)):  # the smallest number spreads along links until nothing changes
        now = np.where(s, least, len(x)).min(axis=1)
        if (now == least).all():
            break
        least = now
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(least.tolist()))
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_mixing(spark, docs):
    rows = [(i, "big" if i < 900 else f"s{i % 4}", 10 + i % 7) for i in range(1000)]
    d = written(spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("_row", F.lit(0)), "m")
    per = d.groupBy("source").agg(F.sum("tokens").alias("n_tokens"))
    plan = mixing.exponent(per, entropy=0.9, repeats=8.0).first()
    share = np.array(plan.tokens) / sum(plan.tokens)

    def weights(k):
        w = share ** (k / mixing.GRID)
        return w / w.sum()

    ok = [k for k in range(mixing.GRID + 1) if -(weights(k) * np.log(weights(k))).sum() >= 0.9 * np.log(5) - 1e-9]
    over = [k for k in range(mixing.GRID + 1) if (weights(k) * plan.budget / np.array(plan.tokens)).max() > 8]
    assert plan.k == max(max(ok), max(over, default=-1) + 1) and np.allclose(plan.weights, weights(plan.k))
    out = mixing.mix(d, [], entropy=0.9, repeats=8.0, block_tokens=1000).collect()
    got = Counter()
    for r in out:
        got[r.source] += r.tokens
    for s, w in zip(plan.sources, plan.weights, strict=True):
        assert w * plan.budget - 17 <= got[s] <= w * plan.budget
    assert max(Counter((r.doc_id, r.epoch) for r in out).values()) == 1
    for b in {r.block for r in out}:
        mine = [r.place for r in out if r.block == b]
        assert sorted(mine) == list(range(len(mine))) and len({r.source for r in out if r.block == b}) == 5
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix_documents(none(docs)).count() == 0


def test_mixing_large_and_clashing(spark):
    rows = [(i, "ab"[i % 2], 10_000_000_000_000) for i in range(300)]
    d = written(spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("_row", F.lit(0)), "m")
    blocks = [r.block for r in mixing.mix(d, []).collect()]
    assert len(blocks) == 300 and min(blocks) >= 0
    names = ["row", "_row", "_copies", "copies", "_d", "_r", "_n", "_s", "none", "d", "h", "n", "s", "_h", "_bd", "best", "score", "share"]
    odd = spark.createDataFrame([(i, f"word{i % 7} " * 60, "s", *range(i, i + len(names))) for i in range(20)], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    own = {tuple(r) for r in odd.collect()}
    for f in (mixing.mix_documents, simhash.deduplicated, rules.kept_documents):
        out = f(odd)
        assert out.columns == odd.columns and {tuple(r) for r in out.collect()} <= own
    assert simhash.deduplicated(odd).count() == 7


def test_running_sum(spark):
    d = written(spark.range(500).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("b"), "id", (F.col("id") % 5).alias("v")), "r")
    got = {r.id: r.s for r in running_sum(d, ["g"], ["id"], "b", "v", "s").collect()}
    for g in range(3):
        at = 0
        for i in sorted(range(g, 500, 3), key=lambda i: (i % 7, i)):
            assert got[i] == at
            at += i % 5


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(400, 400 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = table(spark, SF, "documents"), []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, SF), name)
        sizes.append(at.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
        if name == "quality_rules":
            kept = {r.doc_id: r.text for r in at.collect()}
            assert all(not (n < 50 or 100 * rep > 50 * n) for n, _, _, _, rep in map(brute_counts, kept.values()))
        if name == "simhash_near_dedup":
            ids = sorted(kept)
            roots = brute_components([brute_fingerprint(kept[i]) for i in ids])
            least = {}
            for i, r in zip(ids, roots, strict=True):
                least.setdefault(r, i)
            assert sorted(r.doc_id for r in at.collect()) == sorted(least.values())
    assert sizes[0] <= docs.count() and sizes[2] <= sizes[1] <= sizes[0] and sizes[4] > 0


def test_queries(spark):
    for name, q in entries.queries().items():
        if name.startswith(("op6", "op10", "op3")):
            assert q(spark, SF).count() > 0, name
    assert set(entries.oracle_sql()) <= set(entries.queries())
