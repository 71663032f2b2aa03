"""Each operator against brute force, a round trip, or held-out accuracy, and
over nulls, empty and long texts, repeated rows, empty tables and extra columns
with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import bpe, chat, exact_dedup, jaccard_join, langid, media, packing, pii, queries, token_counts, toxicity

VOCABULARY = queries.vocabulary()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, salt int, key string, n int, sid long, root long"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, 1, "k", None, 2, 3) for i, t in rows], EXTRA)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "word " * 3000), (None, "null id"), (5, "é🎉 <|endoftext|> don't  x")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_bpe(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = bpe.encode_documents(odd, VOCABULARY).collect()
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in ODD)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in rows) == want
    assert bpe.encode_documents(empty, VOCABULARY).count() == 0
    coder, rng = bpe.encoder(VOCABULARY), random.Random(0)
    words = ["".join(rng.choice("aeiounrst éß3") for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["ab" * 400]
    assert coder.encode(words) == [np.array(t.encode(w).ids, "<u4").tobytes() for w in words]
    for w in words[:100]:  # exact merging alone agrees too
        assert coder.vocabulary.merge(w.strip().replace(" ", "").encode() or b"a") is not None


def test_packing(spark, odd, empty):
    rows = [r.asDict() for r in packing.pack(odd, VOCABULARY, size=64, keep_ids=True).collect()]
    seqs = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(empty, VOCABULARY).count() == 0
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


def test_sum_of_squares_against_brute_force():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 21, 300)
    bins, offsets, fill = packing.sum_of_squares(sizes, 20)
    open_, used = [], 0  # gaps of open bins
    for s in sorted(sizes.tolist(), reverse=True):
        def total(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g < 20)

        options = [(total(open_[:i] + open_[i + 1 :] + [g - s]), 0, g, i) for i, g in enumerate(open_) if g >= s] + [(total([*open_, 20 - s]), 1, 20, None)]
        _, _, g, i = min(options, key=lambda o: (o[0], o[1], o[2]))
        if i is None:
            used += 1
            open_.append(20 - s)
        else:
            open_[i] = g - s
    assert len(fill) == used and fill.sum() == sizes.sum() and max(fill) <= 20


def test_merging_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    docs = table(spark, [(i, "w " * (i % 90)) for i in range(400)])
    rows = packing.pack(docs, VOCABULARY, size=128).toPandas().sort_values(["sequence_id", "offset"])
    assert ((rows["offset"] + rows["length"]).groupby(rows["sequence_id"]).shift(fill_value=0) == rows["offset"]).all()
    assert (rows.groupby("sequence_id")["length"].sum() <= 128).all()
    assert rows["sequence_id"].nunique() <= 1.05 * rows["length"].sum() / 128 + 1


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) < 256 for x in m.split(".")) if k == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if ok(k, m.group()))


def test_pii(spark, odd, empty):
    rng = random.Random(3)
    parts = ["a@b.c", "x.y@z", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é", "🎉", " ", "\n", ".", "5", "@", "GB82 WEST 1234 5698 7654 32"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(900, "9" * 30000), (901, "a" * 50000 + "@b.c " + "1.2.3.4 " * 3000), (902, None)]
    found = pii.personal_data(table(spark, rows)).select("doc_id", pii.digest(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))).alias("d"), "n_iban").collect()
    assert {r["doc_id"]: r["d"] for r in found} == {i: brute_spans(t or "") for i, t in rows}
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(empty).count() == 0
    (r,) = pii.personal_data(table(spark, [(1, "My IBAN is GB82 WEST 1234 5698 7654 32."), ])).collect()
    (s,) = [s for s in r["spans"] if s["kind"] == "iban"]
    assert (s["start"], s["end"], s["score"]) == (11, 38, 0.95)
    assert pii.personal_data(table(spark, [(1, "GB82 WEST 1234 5698 7654 33")])).first()["n_iban"] == 0
    out = {r["doc_id"]: r for r in pii.redacted(table(spark, [(1, "mail a@b.c now"), (2, None), (3, "x")])).collect()}
    assert out[1]["text"] == "mail [EMAIL] now" and out[2]["text"] is None and out[3]["text"] == "x" and list(out[1].asDict()) == [c.split()[0] for c in EXTRA.split(", ")]


def test_secrets_need_context(spark):
    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'x token = "{hexes}" y'), (2, f"commit {hexes} done"), (3, "token " + "a" * 40), (4, "password: " + "Zk3+/" * 8 + "== end"), (5, "key " + "a1" * 30000), (6, f"API KEY {hexes}{'z' * 3}, {hexes}"), (7, "token " + "ab1 " * 20)]
    found = {r["doc_id"]: (r["n_secret"], [(s["start"], s["end"], round(s["score"], 2)) for s in r["spans"] if s["kind"] == "secret"]) for r in pii.personal_data(table(spark, rows)).collect()}
    assert found == {1: (1, [(11, 51, 0.55)]), 2: (0, []), 3: (0, []), 4: (1, [(10, 52, 0.55)]), 5: (1, [(4, 60004, 0.55)]), 6: (1, [(8, 51, 0.55)]), 7: (0, [])}
    assert pii.redacted(table(spark, rows[:2])).orderBy("doc_id").collect()[0]["text"] == 'x token = "[SECRET]" y'


def test_iban_among_words(spark):
    good = {"GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606"}
    rows, want = [], {}
    for i in good:
        for before, after in (("", " BIC NWBKGB2L"), ("IBAN ", " EUR 50"), ("REF NO12 3456 789 ", " 2024"), ("AB12 CD34 ", " AND DE89 3704 0044 0532 0130 00"), ("é🎉 ", "."), ("(", ") Bic")):
            rows.append((len(rows), before + i + after))
            want[len(rows) - 1] = [i] + ["DE89 3704 0044 0532 0130 00"] * ("DE89" in after)
    rows += [(900, "GB82WEST123456987654321 X"), (901, "xGB82WEST12345698765432"), (902, "GB82WEST12345698765433 EUR"), (903, "GB82 WEST 1234 5698 7654 32 " * 1500)]
    want |= {900: [], 901: [], 902: [], 903: ["GB82 WEST 1234 5698 7654 32"] * 1500}
    texts = dict(rows)
    found = pii.personal_data(table(spark, rows)).collect()
    assert {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in found} == want
    assert pii.redacted(table(spark, [(1, "to GB82WEST12345698765432 BIC NWBKGB2L")])).first()["text"] == "to [IBAN] BIC NWBKGB2L"


def test_media(spark, odd, empty):
    rows = media.media_columns(odd).collect()
    texts = {i: (t or "").encode() for i, t in ODD}
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        (t,) = media.walk(r["media"])
        assert media.read_back(r["media"], t) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["n_bytes"] == len(raw) and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media"][t.keyframes[-1][0] : t.keyframes[-1][1]] == payload[(len(t.keyframes) - 1) * 12 * 576 :][:576]
    assert media.media_columns(empty).count() == 0
    with pytest.raises(ValueError):
        media.walk(b"\0\0\0\x20ftyp")


def test_media_malformed_and_other_layouts():
    import struct

    good = media.store(bytes(range(256)) * 9 * 30)  # 120 frames
    (t,) = media.walk(good)
    assert media.read_back(good, t) == bytes(range(256)) * 9 * 30
    rng = random.Random(0)
    for _ in range(400):  # whatever is broken, the answer is ValueError or a whole walk
        bad = bytearray(good[: rng.choice([len(good), rng.randrange(len(good))])])
        for _ in range(rng.randint(1, 4)):
            if bad:
                bad[rng.randrange(min(len(bad), 900))] = rng.randrange(256)
        try:
            for found in media.walk(bytes(bad)):
                assert found.samples.max(initial=0) <= len(bad)
        except ValueError:
            pass
    for kind in (b"mdhd", b"stsd", b"stsz", b"stco", b"stsc", b"stts"):
        with pytest.raises(ValueError):
            media.walk(good.replace(kind, b"free"))

    def parts(data):
        return {k: data[a:b] for k, a, b in media.boxes(memoryview(data))}

    moov, mdat = bytes(parts(good)[b"moov"]), bytes(parts(good)[b"mdat"])
    trak = next(bytes(memoryview(moov)[a:b]) for k, a, b in media.boxes(memoryview(moov)) if k == b"trak")
    # two tracks, one inside the other; 64-bit box size; mdat to the file's end
    nested = media.box(b"moov", media.box(b"trak", trak, media.box(b"trak", trak)))
    wide = struct.pack(">I4sQ", 1, b"moov", len(nested) + 8) + nested[8:]
    both = media.walk(media.box(b"ftyp", b"isom") + wide + struct.pack(">I4s", 0, b"mdat") + mdat)
    assert [x.n_samples for x in both] == [120, 120]
    # co64 and a version-1 mdhd
    at = struct.unpack(f">{(len(stco := find(trak, b'stco')) - 8) // 4}I", stco[8:])
    other = trak.replace(b"", b"")
    for kind, made in ((b"stco", media.full(b"co64", 0, media.u32(len(at)), struct.pack(f">{len(at)}Q", *at))), (b"mdhd", media.full(b"mdhd", 0, struct.pack(">QQIQ", 0, 0, 25, 120), bytes(4), version=1))):
        other = swapped(other, kind, made)
    (x,) = media.walk(media.box(b"ftyp", b"isom") + media.box(b"moov", media.box(b"trak", other)) + bytes(len(good)))
    assert (x.timescale, x.duration, x.n_samples) == (25, 120, 120) and (x.samples == t.samples).all()


def find(data, kind):
    for k, a, b in media.boxes(memoryview(data)):
        if k == kind:
            return bytes(data[a:b])
        if k in media.NESTED and (found := find(data[a:b], kind)) is not None:
            return found


def swapped(data, kind, made):
    out = b""
    for k, a, b in media.boxes(memoryview(data)):
        out += made if k == kind else media.box(k, swapped(data[a:b], kind, made)) if k in media.NESTED else media.box(k, data[a:b])
    return out


def test_exact_dedup(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "b" * 70000, "b" * 69999 + "c", f"t{i % 40}"])) for i in range(500)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(table(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    odd_rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(odd_rows) == len(ODD) and sum(r["kept"] for r in odd_rows if r["doc_id"] == 3) == 1
    assert exact_dedup.without_duplicates(odd).count() == 5 and exact_dedup.exact_duplicates(empty).count() == 0
    a, b = b"x" * 100, b"yz" * 77
    assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == exact_dedup.fingerprint(a + b) == exact_dedup.fingerprint_stream(a + b, 7)


def test_chunks_and_collisions(spark, monkeypatch):
    text = "".join(random.Random(1).choice("abc é") for _ in range(5000))
    chunks = spark.createDataFrame([(1, k, text[i : i + 700]) for k, i in enumerate(range(0, 5000, 700))], "doc_id long, chunk int, text string")
    whole = exact_dedup.fingerprints(table(spark, [(1, text)]).select("doc_id", "text")).first()
    assert exact_dedup.combine_chunks(chunks).first()[:4] == whole[:4]
    odd = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, None), (2, 0, "a"), (2, 2, "b"), (3, 0, "a"), (3, 0, "b"), (4, None, "a"), (None, 0, "ab"), (9007199254740993, 0, "x")], "doc_id long, chunk int, text string")
    found = {r["doc_id"]: r["n_bytes"] for r in exact_dedup.combine_chunks(odd).collect()}
    assert found == {1: 1, 2: None, 3: None, 4: None, None: 2, 9007199254740993: 1} and exact_dedup.combine_chunks(odd.limit(0)).count() == 0
    # a fingerprint that sees lengths only: comparison must part unequal texts
    monkeypatch.setattr(exact_dedup, "fingerprint_stream", lambda data: len(data))
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "d"])]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(table(spark, rows)).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (4, 2), 4: (4, 2), 3: (3, 1), 5: (5, 1)}


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, odd, empty):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(260):
        w = list(base[i % 25])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w + passage if i % 5 == 0 else w).upper() if i % 2 else " ".join(w + passage if i % 5 == 0 else w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.near_duplicates(odd).count() == len(ODD) and jaccard_join.near_duplicates(empty).count() == 0
    assert jaccard_join.one_of_each(odd).count() == len(ODD)


def test_small_regions_again(spark, monkeypatch):
    """Regions beyond the size that is compared at once are joined again."""
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_sketch_bounds_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (400, 300))
        differ = sum(bin(int(a) & (1 << 64) - 1 ^ int(b) & (1 << 64) - 1).count("1") for a, b in zip(jaccard_join.sketch(x), jaccard_join.sketch(y), strict=True))
        assert differ <= len(np.setxor1d(x, y))


def test_token_counts(spark, odd, empty):
    texts = [(1, "ab\ncd\n\nef gh"), (2, "é\n🎉x\n"), (3, None)]
    rows = token_counts.section_tokens(table(spark, texts), VOCABULARY).collect()
    coder = packing.library_encoder(VOCABULARY)
    for i, t in texts:
        own = sorted((r["section"], r["start"], r["end"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        assert sum(x[3] for x in own) == len(coder.encode(t or "")) and own[0][1] == 0 and own[-1][2] == len(t or "")
        assert "".join((t or "")[a:b] for _, a, b, _ in own) == (t or "")
    # a token over "ab|c" goes left, over "a|bc" right, over "a|b" left
    assert token_counts.attribute(np.array([0, 0, 0]), np.array([3, 3, 2]), np.array([2, 9])).tolist()[0] == 0
    assert token_counts.attribute(np.array([0]), np.array([3]), np.array([1, 9])).tolist() == [1]
    assert token_counts.attribute(np.array([0]), np.array([2]), np.array([1, 9])).tolist() == [0]
    assert token_counts.section_tokens(empty, VOCABULARY).count() == 0 and token_counts.section_tokens(odd, VOCABULARY).count() == len(ODD)


def brute_sections(text, ids, coder, sections):
    """Token by token and code point by code point."""
    owner_of, data = [], text.encode()
    byte_point = [i for i, c in enumerate(text) for _ in c.encode()]
    starts = [0, *sections[:-1]]
    tokens, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for t in ids:
        n = len(coder.decode_single_token_bytes(t))
        points = sorted({byte_point[k] for k in range(at, at + n)})
        at += n
        held = [next(k for k, (a, b) in enumerate(zip(starts, sections)) if a <= p < b) for p in points]
        best = max(set(held), key=lambda k: (held.count(k), -k))
        tokens[best] += 1
        crossing[best] += len(set(held)) > 1
        owner_of.append(best)
    assert at == len(data)
    return list(zip(range(len(sections)), starts, sections, tokens, crossing))


def test_token_counts_against_brute_force(spark):
    rng, coder = random.Random(12), packing.library_encoder(VOCABULARY)
    parts = ["word ", "é", "🎉", "\n", "\n\n\n", "   ", "international", "'ll", "१२"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        rows.append((i, text, [rng.choice([None, rng.randint(-2, len(text) + 3)]) for _ in range(rng.randint(0, 12))] if i % 10 else None, rng.choice(["a title", None, "é"]), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, ends array<int>, title string, section string")
    pick = lambda df: {i: sorted((r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]) for r in found) for i, found in by_doc(df.collect()).items()}
    lines, spans, fields = pick(token_counts.section_tokens(docs, VOCABULARY)), pick(token_counts.section_tokens(docs, VOCABULARY, ends="ends")), pick(token_counts.section_tokens(docs, VOCABULARY, fields=("title", "text", "section")))
    for i, text, ends, title, _ in rows:
        ids = coder.encode(text)
        breaks = [k + 1 for k, c in enumerate(text) if c == "\n"]
        assert lines[i] == brute_sections(text, ids, coder, breaks if breaks and breaks[-1] == len(text) else [*breaks, len(text)])
        given = sorted(min(max(e, 0), len(text)) for e in ends or [] if e is not None)
        assert spans[i] == brute_sections(text, ids, coder, given if given and given[-1] == len(text) else [*given, len(text)])
        own = [(title or "") + "\n", text + "\n", "x"]
        closed = [len(own[0]), len(own[0]) + len(own[1]), len("".join(own))]
        assert fields[i] == brute_sections("".join(own), coder.encode("".join(own)), coder, closed)
    assert any(c for r in spans.values() for *_, c in r)


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 80))]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scum", "moron", "scums!"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, y = table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.learn(d, y, queries.remainder(5) != 0)
    rows = toxicity.score(d, field).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 7 == 0) for r in held]) > 0.97
    for r in rows:
        assert all(re.search("scum|moron", docs[r["doc_id"]][1][s["start"] : s["end"]]) for s in r["spans"])
    assert toxicity.score(odd, field).count() == len(ODD) and toxicity.score(empty, field).count() == 0
    assert toxicity.learn(empty, y, F.lit(True)) is None and toxicity.score(odd, None).filter("score > 0.6").count() == 0


def test_marginals_against_enumeration():
    odds, moves = np.array([0.5, 3.0, 0.2, 2.0]), np.array([[0.9, 0.1], [0.4, 0.6]])
    total, hit = 0.0, np.zeros(4)
    for k in range(16):
        s = [k >> i & 1 for i in range(4)]
        p = np.prod([odds[i] if s[i] else 1 for i in range(4)]) * np.prod([moves[s[i], s[i + 1]] for i in range(3)])
        total += p
        hit += p * np.array(s)
    got = toxicity.marginals(np.concatenate([odds, odds[:1]]), np.array([4, 1, 0]), moves)
    assert np.allclose(got[:4], hit / total) and np.isclose(got[4], 0.5 / 1.5)


def test_toxicity_chains_against_plain_recursion():
    """Documents of many lengths, 64 words and more included, against a plain
    forward-backward per document; expected pairs too."""
    rng = np.random.default_rng(8)
    lengths = np.array([1, 0, 3, 200, 64, 65, 2, 0, 1000])
    odds, moves = np.exp(rng.normal(0, 3, lengths.sum())), np.array([[0.7, 0.02], [1.5, 0.3]])
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        o = odds[at : at + n]
        at += n
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            a[t] = (a[t - 1] @ moves if t else 1) * np.array([1, o[t]])
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = moves @ (np.array([1, o[t + 1]]) * b[t + 1])
            b[t] /= b[t].sum()
        want += (a * b / (a * b).sum(axis=1, keepdims=True))[:, 1].tolist()
        for t in range(1, n):
            x = a[t - 1][:, None] * moves * (np.array([1, o[t]]) * b[t])[None]
            pairs += x / x.sum()
    starts = toxicity.starts_of(lengths)
    assert np.allclose(toxicity.marginals(odds, lengths, moves), want)
    assert np.allclose(toxicity.pair_counts(odds, starts, moves, *toxicity.both_ways(odds, starts, moves)), pairs)


def test_toxicity_score_against_brute_force(spark, odd):
    """The query's scores from the field's weights, word by word in Python."""
    import pyarrow as pa

    docs = [f"w{i % 9} (scum), W{i % 5}! moron" if i % 3 == 0 else f"w{i % 9} fine {'x' * (i % 7)}" for i in range(300)]
    y = np.array([int(i % 3 == 0) for i in range(300)])
    field = toxicity.fit_field(pa.array(docs), y, np.ones(300))
    for text in [*docs[:20], "", "scum " * 100, "!!! é ßa"]:
        odds = []
        for w in text.split():
            core = re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
            names = [(core, 0), *((core[:k], k) for k in (3, 4, 5, 6) if len(core) > k), *((core[-3:], 9) for _ in range(len(core) > 3))]
            odds.append(np.exp(field.bias + sum(field.weights[int(toxicity.hashes(pa.array([f]), seed)[0]) & (1 << toxicity.BITS) - 1] for f, seed in names)))
        p = toxicity.marginals(np.clip(np.array(odds), np.exp(-15), np.exp(15)), np.array([len(odds)]), field.moves)
        x = [1, np.log1p(p.sum()), p.max(initial=0), np.sqrt(p.sum() / max(1, len(p)))]
        assert np.isclose(toxicity.judged(field, pa.array([text]))[2][0], 1 / (1 + np.exp(-(x @ field.scorer))))


def test_langid(spark, odd, empty):
    rng = random.Random(6)
    lexicon = {"en": ["the", "house", "with", "ing", "water"], "de": ["der", "haus", "mit", "ung", "wasser"]}
    rows = [(i, " ".join(rng.choice(v) + rng.choice(v) for _ in range(30)), k) for i, (k, v) in enumerate(list(lexicon.items()) * 100)]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(d, langid.learn(d, queries.remainder(4) != 2)).collect()}
    assert np.mean([found[i]["lang_pred"] == k for i, _, k in rows]) > 0.97
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in found.values())
    # sizes by brute force, over texts on both sides of 2000 bytes
    learned = langid.learn(d, queries.remainder(4) != 2)
    long = [(i, (t + " ") * 20, k) for i, t, k in rows[:10]] + [(900 + i, t[: 7 * i], k) for i, t, k in rows[:10]]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(long, "doc_id long, text string, lang string"), learned).collect()}
    for i, t, _ in long:
        data = langid.reduced(t)
        best = min(((len(tool.compress(data)), n, lang) for n, (lang, tool) in enumerate(learned.compressors())), default=(0, 0, "und"))[2] if data else "und"
        assert got[i] == best
    assert sum(len(c) for _, c in learned.dictionaries) <= 2 * (langid.DICTIONARY_BYTES + langid.DOCUMENTS)
    for at in range(40):
        piece = langid.share(b"ab cde fghi j klmno", at, 9)
        assert len(piece) <= 9 and all(w in b"ab cde fghi j klmno".split() for w in piece.split())
    assert langid.learn(d.withColumn("doc_id", F.lit(None).cast("long")), queries.remainder(4) != 2).dictionaries == ()
    nothing = langid.learn(empty, F.lit(True))
    assert langid.identify(odd, nothing).filter("lang_pred <> 'und'").count() == 0 and langid.identify(empty, nothing).count() == 0


def test_rows_stay_with_clashing_columns(spark):
    """Repeated rows, nulls and columns named as the operator's own."""
    rows = [(1, "a", 1, "x"), (1, "a", 1, "x"), (2, "a", 2, "y"), (None, "a", 3, "z"), (None, None, 4, "u"), (5, "", 5, "v"), (6, "q", 6, None)] + [(7, "r", 7, "w")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long, `__sha` string").withColumns({"row": F.lit(1), "word": F.lit(2), "kept": F.lit(3)})
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(str, (tuple(r)[:4] for r in kept.collect()))) == sorted(map(str, [rows[2], rows[5], rows[6], rows[7]]))


def test_hot_group_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    rows = [(i % 50, "same") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(30)]
    found = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    assert len(found) == 330 and sum(r["kept"] for r in found) == 31 and {r["group_size"] for r in found if r["doc_id"] < 1000} == {300} and {r["keep_id"] for r in found if r["doc_id"] < 1000} == {49}


def test_chat_nested_schemas(spark):
    schema = {"find": {"where": ({"object": {"city": ("string", True), "zip": ("integer", False)}}, True), "tags": ({"array": "string"}, False), "sort": ({"enum": ["asc", "desc", 3]}, False)}}
    cases = [
        ('{"where": {"city": "x"}}', True), ('{"where": {"city": "x", "zip": 1}, "tags": [], "sort": "asc"}', True), ('{"where": {"city": "x"}, "tags": ["a", "b"], "sort": 3}', True),
        ('{"where": {"zip": 1}}', False), ('{"where": {"city": 5}}', False), ('{"where": {"city": "x", "street": "y"}}', False), ('{"where": []}', False), ('{"where": "x"}', False),
        ('{"where": {"city": "x"}, "tags": ["a", 1]}', False), ('{"where": {"city": "x"}, "tags": "a"}', False), ('{"where": {"city": "x"}, "sort": "up"}', False), ('{"tags": []}', False), ("null", False), ("", False), (None, False),
    ]
    m = spark.createDataFrame([("c", i, "assistant", None, str(i), None, "find", a, None) for i, (a, _) in enumerate(cases)], "conv_id string, turn int, role string, content string, call_id string, answers string, name string, arguments string, depends_on array<string>")
    assert {r["turn"]: r["valid"] for r in chat.link_tool_calls(m, schema).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}


def test_chat_diamonds_and_repeats(spark):
    """Levels by brute force on random graphs with several dependencies, ids
    and messages that repeat, several results, clashing columns."""
    rng = random.Random(1)
    needs = {f"c{i}": [f"c{rng.randrange(i)}" for _ in range(rng.randint(0, 3)) if i] for i in range(40)}
    needs |= {"x": ["y"], "y": ["x"], "z": ["x", "c1"]}

    def level(c, seen=()):
        if c in seen:
            return None
        below = [level(n, (*seen, c)) for n in needs[c]]
        return None if None in below else 1 + max(below, default=-1)

    rows = [("c", i, "assistant", "w " * 20000 if i == 3 else None, c, None, "t", "{}", n) for i, (c, n) in enumerate(needs.items())]
    rows += rows[:3] + [("c", 90, "tool", "r", None, "c5", None, None, None), ("c", 91, "tool", "r", None, "c5", None, None, None)] + [("c", 92, "assistant", None, "c7", None, "t", "{}", ["gone"])] + [(None, None, None, None, None, None, None, None, None)] * 3
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, content string, call_id string, answers string, name string, arguments string, depends_on array<string>").withColumns({"id": F.lit(1), "linked": F.lit(2), "needs": F.lit(3)})
    got = chat.link_tool_calls(m, {"t": {}}).collect()
    assert len(got) == len(rows) and all(r["level"] == level(r["id"]) for r in got if r["id"])
    assert [r["linked"] for r in got if r["id"] == "c5"] == [True] * 3


def test_chat(spark):
    rows = [
        ("c", 1, "assistant", None, "a", None, "add", '{"y": 2, "x": 1}', []),
        ("c", 2, "tool", "3", None, "a", None, None, None),
        ("c", 3, "assistant", None, "b", None, "add", '{"x": "1", "y": 2}', ["a", "gone"]),
        ("c", 4, "assistant", None, "d", None, "add", "no json", ["b"]),
        ("c", 5, "assistant", None, "e", None, "other", "{}", ["f"]),
        ("c", 6, "assistant", None, "f", None, "add", '{"x": 1, "y": 2, "z": 3}', ["e"]),
        ("c", 7, "tool", "?", None, "zz", None, None, None),
        (None, None, "user", "hi", None, None, None, None, None),
    ]
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, content string, call_id string, answers string, name string, arguments string, depends_on array<string>")
    got = {r["turn"]: r for r in chat.link_tool_calls(m, {"add": {"x": ("integer", True), "y": ("number", True)}}).collect()}
    assert [(got[t]["linked"], got[t]["valid"], got[t]["level"]) for t in range(1, 8)] == [(True, True, 0), (True, None, 0), (False, False, 1), (False, False, 2), (False, False, None), (False, False, None), (False, None, None)]
    assert got[1]["canonical"] == '{"arguments":{"x":1,"y":2},"call_id":"a","name":"add","role":"assistant","turn":1}'
    assert got[None]["canonical"] == '{"content":"hi","role":"user"}'
    assert chat.link_tool_calls(m.limit(0), {}).count() == 0


def test_drop_toxic_by_row(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), queries.remainder(5) != 0)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, field, keep_spans=False).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    toxic = [rows[i] for i in sorted(scored) if scored[i]][-1]
    clean = [rows[i] for i in sorted(scored) if not scored[i]][-1]
    made = [r.asDict() | {"doc_id": i} for r in (toxic, clean) for i in (None, 10**9)] + [clean.asDict() | {"doc_id": None, "text": None}]
    more = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in made], docs.schema))
    kept = p.drop_toxic(spark, more, sf).collect()
    want = [tuple(r) for i, r in rows.items() if not scored[i]] + [tuple(r[c] for c in docs.columns) for r in made[2:]]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_library_encoder_agrees():
    from tokenizers import Tokenizer

    coder, t = packing.library_encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(11)
    parts = ["é", "🎉", "<|endoftext|>", "don't", "  ", "\n", "\r\n\t", "\u00a0", "\u3000", "१२", "ﬁ", "e\u0301", "中文", "A", "word", " 1234567", "'ll", "...", "\x00", "\u200d"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    long = ["word " * 20000, "a" * 5000, " " * 5000, "\n" * 5000, "é🎉" * 3000]
    blanks = [" " * 2000000, "\n" * 2000000, " " * 2000000 + "a", "b" + " \n" * 1000000 + "c", "\u3000" * 20000 + "x" + "\t" * 20000, " " * 20000 + "<|endoftext|>" + "\n" * 20000 + "<|endoftext|>y", "\x1c" * 20000, "a" * 2000000]
    for text in [x or "" for _, x in ODD] + odd + long + blanks:
        assert packing.token_ids(coder, text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_blanks_and_exact_ids(spark):
    """Ids of pieces against the tokenizers library; large ids beside nulls."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = [(9007199254740993, " " * 1000000 + "a"), (None, "x"), (9007199254740995, "\n" * 700000), (None, None)]
    found = by_doc(packing.pack(table(spark, rows), VOCABULARY, keep_ids=True).collect())
    assert set(found) == {9007199254740993, 9007199254740995, None}
    for i, text in rows:
        if i:
            assert [x for r in sorted(found[i], key=lambda r: r["piece"]) for x in r["ids"]] == [*t.encode(text, add_special_tokens=False).ids, 0]
    assert sum(r["n_tokens"] for r in token_counts.section_tokens(table(spark, rows[:1]), VOCABULARY).collect()) == len(t.encode(rows[0][1]).ids)


def test_library_encoder_over_documents(spark):
    from tokenizers import Tokenizer

    coder, t = packing.library_encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert packing.token_ids(coder, r["text"] or "").tolist() == t.encode(r["text"] or "", add_special_tokens=False).ids


def test_pipeline(spark):
    """Stages against brute force, each on its own input."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    one = p.drop_copies(spark, docs, sf)
    best = {}
    for r in docs.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == set(best.values())
    near = p.drop_near_copies(spark, docs, sf)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {c for _, c in want.values()}
    masked = p.mask_personal_data(spark, docs, sf)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert p.run(spark, sf).agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
