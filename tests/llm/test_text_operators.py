"""The operators on documents against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tests.conftest import SF
from tidemark.llm import bpe, decontaminate, fingerprint, jaccard, language, queries, records, suffix_dedup, textops, token_counts, toxicity

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def sorted_rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


# --- 1, 3: models -----------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["toxic"] is not None]
    held = [(r["score"], y) for r, y in labels if r["held_out"]]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(3, 0), (4, 1), (7, 1), (8, None), (None, 1), (5, 0), (5, 1), (13, 0)], "doc_id long, toxic int")
    out = toxicity.score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(none, labels).count() == 0
    assert all(r["score"] < 1e-9 for r in toxicity.score(odd, labels.where("1 = 0")).collect())


def test_shared_backoff_keeps_unseen_words_even():
    m = toxicity.Ratios({"good": (5, 5), "bad": (0, 9), "fine": (9, 0)})
    assert m.ratio("bad") > 1 > m.ratio("zzzz") and abs(m.ratio("zzzz")) < 0.5 and m.ratio("fine") < 0


def test_language(spark):
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_language_odd(odd, none):
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd).collect()]
    by = {i: p for i, p, _ in out}
    assert len(out) == odd.count() and by[0] == by[1] == by[2] == by[6] == "und" and by[3] == "en"
    assert all(0 <= s <= 1 for *_, s in out)
    assert language.predict(none).count() == 0
    kept = language.keep(odd)
    assert kept.columns == odd.columns and {0, 1, 2, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_language_backs_off_to_characters():
    m = language.Model(["en", "de"], {"the": {"en": 9}, "und": {"de": 9}}, {"sch": {"de": 9}, "ing": {"en": 9}, "s": {"en": 5, "de": 5}})
    the, geschenk, walking = m.evidence(["the", "geschenk", "walking"])
    assert the[0] > the[1] and geschenk[1] > geschenk[0] and walking[0] > walking[1]


# --- 2: Order MinHash -------------------------------------------------------------------------------------

M = (1 << 64) - 1


def _long(x, seed):
    return xxhash.xxh64_intdigest((x & M).to_bytes(8, "little"), seed)


def order_minhash(text, k=3, size=2):
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text)]
    found, slots = {}, {}
    for i in range(max(1, len(h) - k + 1) if h else 0):
        s = 42
        for x in h[i : i + k]:
            s = _long(x, s)
        s >>= 24
        n = found[s] = found.get(s, -1) + 1
        v = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), _long(s - (1 << 40) if s >> 39 else s, 42)) >> 24
        slots.setdefault(v >> 34, []).append((v - (1 << 40) if v >> 39 else v, i))
    out = set()
    for s, m in slots.items():
        q = 42
        for v, _ in sorted(sorted(m)[:size], key=lambda p: p[1]):
            q = _long(v, q)
        out.add(f"{s << 32 | q & 0xFFFFFFFF:x}")
    return out


def test_order_minhash(docs, rows):
    by = {i: t or "" for i, t, _ in rows}
    ids = sorted(by)
    out = {r["doc_id"]: r for r in fingerprint.edited(docs).collect()}
    assert len(out) == len(ids)
    for n, i in enumerate(ids):
        t, m, r = by[i], len(by[i]) // 3, out[i]
        e = t[: len(t) - m] + by[ids[n - 1]][:m]
        a, b, c = order_minhash(t), order_minhash(e), order_minhash(by[ids[n - 1]])
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len({v[:-8] for v in x | y})
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert set(filter(None, r["fingerprint"].split("."))) == a and set(filter(None, r["edited_fingerprint"].split("."))) == b
        assert abs(r["near_edited"] - like(a, b)) < 1e-9 and abs(r["near_next"] - like(a, c)) < 1e-9


def test_order_minhash_odd(odd, none):
    out = fingerprint.edited(odd).collect()
    assert len(out) == odd.count() and all(r["near_next"] is None for r in out if r["doc_id"] is None)
    assert fingerprint.edited(none).count() == 0
    by = {}
    for r in fingerprint.fingerprints(odd).collect():
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[10] == by[11] and by[13] == by[14] and by[0] == by[1] == {""}


def test_order_minhash_sees_moved_text(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c = " ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:-4])
    fp = fingerprint.add_fingerprint(spark.createDataFrame([(a, b, c)], "a string, b string, c string"), "a", "fa")
    fp = fingerprint.add_fingerprint(fingerprint.add_fingerprint(fp, "b", "fb"), "c", "fc")
    r = fp.select(fingerprint.likeness("fa", "fb").alias("moved"), fingerprint.likeness("fa", "fc").alias("cut"), fingerprint.likeness("fa", "fa").alias("same")).first()
    assert r["same"] == 1.0 and r["cut"] > r["moved"] and r["cut"] > 0.9


# --- 4, 6, 9: tokens --------------------------------------------------------------------------------------


def odd_texts(n=1500):
    r = random.Random(4)
    letters = "ab \n\t\r    \x1c\x85é1²½Ⅷ's't<|endoftext|>字ß́_-ΣİÇ"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["a" * 3000, " " * 300, " lead", "trail ", "a  b", "a\n b", "x\n\n\ny", "ΟΔΥΣΣΕΥΣ ΣΣ", "\x00 \x00a", "<|endoftext|><|endoftext|>"]


def test_bpe_is_the_library(rows):
    e, t = bpe.encoder(BYTES), tokenizers.Tokenizer.from_file(BYTES)
    texts = odd_texts() + [x or "" for _, x, _ in rows[:60]]
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 64) for x in e.encode_batch(texts[i : i + 64])]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [e.merges.decode(x) for x in got] == [t.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_checks_and_merges():
    m = bpe.encoder(BYTES).merges
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 12))) for _ in range(400)]
    got = m.encode_words(words)
    assert got == [m.exact(w) for w in words] and any(m.greedy(w) != g for w, g in zip(words, got, strict=True))
    a = [(x, y) for w in got for x, y in zip(w, w[1:], strict=False)]
    assert m.apart(*np.array(a).T).all() and all(m.stay_apart(*p) for p in a)


def test_bpe_odd(odd, none):
    out = {(r["doc_id"], r["decoded"]): r["n_tokens"] for r in bpe.encode(odd, BYTES).collect()}
    assert len(out) == len({(i, t or "") for i, t in pairs(odd)}) and out[0, ""] == 0 and {(i, t or "") for i, t in pairs(odd)} == set(out)
    assert bpe.encode(none, BYTES).count() == 0 and all(r["round_trip"] for r in bpe.tokenise(odd, BYTES).collect())


def test_token_counts_are_the_library(rows):
    c, t = token_counts.counter(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    texts = odd_texts() + [x or "" for _, x, _ in rows[:60]]
    assert [c.count(x) for x in texts] == [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    for x in texts[:150] + [rows[0][1][:120]]:
        assert c.text_prefixes(x) == [len(e.ids) for e in t.encode_batch([x[:i] for i in range(len(x) + 1)], add_special_tokens=False)]
    for x in texts[:60] + [rows[0][1][:120]]:
        n = c.text_prefixes(x)
        for budget in (0, 1, 5, 10**6):
            assert c.fit(x, budget) == max(i for i, k in enumerate(n) if k <= budget)


def test_token_counts_odd(odd, none):
    out = token_counts.count(odd, WORDS, budget=50).collect()
    assert len(out) == odd.count() and all(r["over_limit"] == (r["n_tokens"] > 50) for r in out) and token_counts.count(none, WORDS).count() == 0
    cut = token_counts.truncate(odd.where("doc_id = 10"), WORDS, 50)
    assert cut.columns == odd.columns and token_counts.count(cut, WORDS).first()["n_tokens"] <= 50


def test_records_round_trip(odd, none, tmp_path):
    folder, manifest = records.write(odd, BYTES, 2)
    out = records.read(folder, manifest).collect()
    t = tokenizers.Tokenizer.from_file(BYTES)
    start, want = 0, []
    for i, x in sorted(((i if i is not None else -(2**63), x or "") for i, x in pairs(odd)), key=lambda p: (p[0], p[1].encode())):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((None if i == -(2**63) else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    m = manifest.orderBy("first_id").first()
    assert records.read_at(folder, m["shard"], m["n_records"] - 1)[1][-1] == 2
    assert records.read(*records.write(none, BYTES, 2)).count() == 0


def test_damaged_records_are_found():
    import io

    data = records.frame(records.payload(7, np.arange(5), 2))
    assert records.parse(records.read_frame(io.BytesIO(data)))[1].tolist() == [0, 1, 2, 3, 4]
    for at in (0, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.read_frame(io.BytesIO(bytes(bad)))


# --- 5: Jaccard join --------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    bases = [[r.choice(words) for _ in range(120)], [r.choice(words) for _ in range(12)]]
    out = []
    for i in range(160):
        b = list(bases[i % 3 == 0])
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            b[r.randrange(len(b))] = r.choice(words)
        out.append((i, " ".join(b[: r.randint(1, len(b))] if i % 7 == 0 else b)))
    return [*out, (600, None), (601, ""), (602, "  "), (603, "one"), (604, "ONE"), (605, "one two"), (3, out[3][1])]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (2, 60)])
def test_jaccard_join(spark, k, num):
    data = near_copies()
    out = jaccard.join(spark.createDataFrame(data, "doc_id long, text string").repartition(3), k, num, 100).collect()
    assert len(out) == len(data) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(data, k, num, 100)


def test_jaccard_join_odd(odd, none):
    out = jaccard.join(odd, 3, 90, 100).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert len(out) == odd.count() and by[0] == (0, 0) and by[11][1] == 10 and by[14][1] == 13 and by[4] == (1, 3)
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {11, 14}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({8: 1000, 500: 10}, 90, 100) >= 8
    z = jaccard.Sizes(90, 100)
    for s in range(1, 60):
        for t in z.partners(s):
            if t and z.overlap(s, t) <= min(s, t):
                o = z.overlap(s, t)
                assert 100 * o >= 90 * (s + t - o) and 100 * (o - 1) < 90 * (s + t - o + 1)


def test_shingles_are_plain_words():
    assert len(textops.shingle_set("A b\tC\x0bd", 3)) == 2 and np.array_equal(textops.shingle_set("A B c", 3), textops.shingle_set(" a b  C ", 3))
    assert len(textops.shingle_set("a b", 3)) == 1 and not len(textops.shingle_set(" \n", 3))


# --- 8: suffix-array dedup --------------------------------------------------------------------------------


def brute_dedup(rows, width):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = seen.get(b[p : p + width], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                cover[p : p + width] = True
        kept = bytes(x for x, c in zip(b, cover, strict=False) if not c)
        out.append((i, len(b), int(cover.sum()), int((np.diff(cover[:-1].astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def overlapping():
    r = random.Random(1)
    base = [" ".join(r.choice(["ab", "cde", "f", "ü", "xyz", "\n"]) + str(r.randint(0, 99)) for _ in range(120)) for _ in range(6)]
    out = []
    for i in range(90):
        a, b, p, q = r.choice(base), r.choice(base), r.randint(0, 400), r.randint(0, 300)
        out.append((i, r.choice([a[p : p + q] + b[q : q + p // 2], a[:q] + str(i), "zz" * r.randint(0, 200), None, "", b, "é, " * r.randint(1, 120)])))
    return [*out, (5, out[5][1]), (None, base[0]), (None, None)]


@pytest.mark.parametrize("width", [200, 51])
def test_suffix_dedup(spark, width):
    data = overlapping()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted_rows(suffix_dedup.dedup(df, width), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_dedup(data, width)


def test_suffix_dedup_odd(odd, none):
    assert sorted_rows(suffix_dedup.dedup(odd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_dedup(pairs(odd), 200)
    assert suffix_dedup.dedup(none).count() == 0
    cut = suffix_dedup.clean(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and all(r["n_chars"] == len(r["text"]) for r in cut.collect())


# --- 10: decontamination ----------------------------------------------------------------------------------


def brute_hits(rows, items, width):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted_rows(queries.op10_benchmark_decontamination(spark, SF), *HITS) == brute_hits([(i, t) for i, t, _ in rows], items, 10)


def test_decontamination_odd_and_in_parts(spark, odd, none, monkeypatch):
    items = [(1, "quick brown fox jumps over"), (2, "One"), (3, None), (4, "..."), (11, "the lazy dog the quick"), (1, "word5 word6"), (None, "Ünïcödé")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(pairs(odd), [(i, t) for i, t in items if i is not None], 4)
    assert sorted_rows(decontaminate.hits(odd, bench, 4), *HITS) == want
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 3)
    assert sorted_rows(decontaminate.hits(odd, bench, 4), *HITS) == want
    left = decontaminate.remove_documents(odd, bench, 4)
    assert left.columns == odd.columns and left.count() == sum(not x[-1] for x in want)
    assert decontaminate.hits(none, bench).count() == 0 and not any(r["contaminated"] for r in decontaminate.hits(odd, bench.where("1 = 0")).collect())
    cut = {r["doc_id"]: r["kept"] for r in decontaminate.hits(odd, spark.createDataFrame([(1, "b c")], "item_id long, text string"), cut=True).collect()}
    assert cut[3] == "one"
