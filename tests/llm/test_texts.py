"""Fingerprints, fertility, packing and WARC against brute force, round trips and odd rows."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from text_maker import words
from tessella.llm import fertility, fingerprint, packing, warc
from tokenizers import Tokenizer


# fingerprints
def test_window_entropy_is_exact():
    rng = np.random.default_rng(3)
    for scale in (fingerprint.LARGE, fingerprint.SMALL):
        data = np.concatenate([rng.integers(97, 97 + k, 90) for k in (1, 3, 20, 60)]).astype(np.uint8)
        got = fingerprint.window_entropy(data, scale)
        for i in range(len(got)):
            c = np.unique(data[i : i + scale.window], return_counts=True)[1] / scale.window
            assert abs(got[i] - 1000 * -(c * np.log2(c)).sum() / np.log2(scale.window)) < 0.51


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(d, t, fingerprint.edited(t, order[(i + 1) % len(order)][1]), order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)]


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_edits_in_any_blocks(docs, blocks):
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs, blocks=blocks).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for d, text, edit, after in brute_edits(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        a, b, c = fingerprint.digest([text.encode(), edit.encode(), after.encode()])
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_string(a), fingerprint.to_string(b))
        assert r.near_edited == fingerprint.likeness(a, b) and r.near_next == fingerprint.likeness(a, c)


def test_digests_do_not_depend_on_the_batch():
    texts = [words(n, n).encode() for n in (0, 1, 3, 10, 60, 90, 500, 4000)] + [b"\xff" * 5000, bytes(range(256)) * 9]
    together = [fingerprint.to_string(d) for d in fingerprint.digest(texts)]
    assert together == [fingerprint.to_string(fingerprint.digest([t])[0]) for t in texts]
    for s in together:
        assert fingerprint.to_string(fingerprint.from_string(s)) == s


def test_likeness():
    a, b = words(900, 1).encode(), words(900, 2).encode()
    x, y, half = fingerprint.digest([a, b, a[: len(a) // 2] + b[len(b) // 2 :]])
    assert fingerprint.likeness(x, x) == 1 and fingerprint.likeness(x, y) < 0.1 < 0.15 < fingerprint.likeness(x, half) < 0.8
    nothing = fingerprint.digest([b""])[0]
    assert fingerprint.likeness(nothing, nothing) == 1 and fingerprint.likeness(nothing, x) == 0


def test_texts_on_both_sides_of_a_scale_share_features():
    for n in (fingerprint.SHORT, 2 * fingerprint.SHORT, fingerprint.TINY, 2 * fingerprint.TINY):
        long = words(400, n).encode()[: n + n // 4]
        x, y, other = fingerprint.digest([long, long[: n - n // 8], words(400, n + 1).encode()[: n - n // 8]])
        assert fingerprint.likeness(x, y) > 0.3 > fingerprint.likeness(x, other)


def test_fingerprints_of_odd_rows(messy, empty, spark):
    out = fingerprint.fingerprint_edits(messy).collect()
    assert len(out) == messy.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprint.fingerprint_edits(empty).count() == 0
    one = fingerprint.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


# fertility
def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


@pytest.mark.parametrize("kind", ["docs", "messy"])
def test_quality_counts(request, kind):
    df = request.getfixturevalue(kind)
    got = fertility.quality(df.withColumn("own", df.text), keep=("own", "doc_id")).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(r.own)
        assert not (r.kept and r.base_failed) and r.kept == (r.reason is None)


def test_fertility_measures_are_those_of_the_vocabulary():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = words(200, 4) + " กข naïve \U0001f600"
    ids = [i for w in text.split() for i in m.encode(w)]
    (row,) = fertility.judge([text.encode()], ["en"])
    n = len(ids)
    p = np.unique(ids, return_counts=True)[1] / n
    assert row[7] == n and row[8] == pytest.approx(row[1] / n) and row[9] == pytest.approx(sum(map(m.is_byte, ids)) / n) and row[10] == pytest.approx(-(p * np.log2(p)).sum())


def test_bands_by_language_and_script():
    judge = lambda t, lang: fertility.judge([t.encode()], [lang])[0]
    rare = "".join(chr(0x12000 + i % 700) for i in range(100))
    noise = " ".join(rare[i : i + 4] for i in range(0, 100, 4)) + " the"
    assert judge(noise, "en")[-1] == "byte_share" or judge(noise, "en")[-1] == "chars_per_token"
    assert judge("ab " * 19 + "cd ef gh ij kl mn op", "en")[5]
    assert judge(" ".join(["привет", "мир", "как", "дела"][i % 4] + "а" * (i % 5) for i in range(25)), None)[-2] == "cyrillic"
    assert fertility.script_of("123 !!") == "other"


def junk(seed):
    import string

    rng = random.Random(seed)

    def parted(s):
        return " ".join(s[i : i + 7] for i in range(0, len(s), 7))

    raw = rng.randbytes(900)
    yield "hex", parted(raw.hex())
    yield "base64", parted(base64.b64encode(raw).decode())
    yield "marks", parted("".join(rng.choice(string.punctuation) for _ in range(900)))
    yield "digits", parted("".join(rng.choice(string.digits) for _ in range(900)))
    yield "letters", parted("".join(rng.choice(string.ascii_lowercase) for _ in range(900)))


def test_junk_is_rejected_whatever_its_language():
    for seed in range(5):
        for kind, text in junk(seed):
            for lang in ("en", "de", "fr", "es", None, "xx"):
                row = fertility.judge([text.encode()], [lang])[0]
                assert not row[5] and not row[6], (kind, lang, row)


def test_clean_rows_of_each_language_are_kept_and_their_shuffled_letters_are_not(spark):
    rng = random.Random(1)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r.text for r in rows if r.lang == lang]
        good = [t for t, j in zip(own, fertility.judge([t.encode() for t in own], [lang] * len(own))) if not j[5]]
        kept = [j[6] for j in fertility.judge([t.encode() for t in good], [lang] * len(good))]
        assert sum(kept) >= 0.98 * len(kept) > 0
        shuffled = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()).encode() for t in good]
        judged = [j for j in fertility.judge(shuffled, [lang] * len(good)) if not j[5]]
        assert sum(j[6] for j in judged) <= 0.02 * len(judged)


def test_ordinary_prose_is_kept():
    prose = {
        "en": "We hold these truths to be self-evident, that all men are created equal, that they are endowed by their Creator with certain unalienable Rights.",
        "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
        "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres.",
        "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται.",
    }
    for lang, text in prose.items():
        assert fertility.judge([text.encode()], [lang])[0][6] and fertility.judge([text.encode()], [None])[0][6], lang


# packing
@pytest.mark.parametrize("kind", ["docs", "messy"])
def test_packing(request, kind):
    df = request.getfixturevalue(kind)
    got = packing.pack(df, length=256 if kind == "messy" else 1024).toPandas()
    length = 256 if kind == "messy" else 1024
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in df.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id, a, len(x := ids[a : a + length]), zlib.crc32(x.tobytes()), len(ids)) for a in range(0, len(ids), length)]
    have = [(None if d != d else int(d), *x) for d, *x in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert list(x["offset"]) == [0, *x["length"].cumsum()[:-1]] and x["length"].sum() <= length


def test_first_fit_decreasing_is_what_it_says():
    rng = random.Random(2)
    for room in (10, 1024):
        sizes = [rng.randint(1, room) for _ in range(200)]
        bins, offsets = packing.first_fit_decreasing(np.array(sizes), room)
        used = []
        for i in sorted(range(200), key=lambda i: -sizes[i]):
            b = next((k for k, u in enumerate(used) if u + sizes[i] <= room), len(used))
            if b == len(used):
                used.append(0)
            assert (bins[i], offsets[i]) == (b, used[b])
            used[b] += sizes[i]


def test_packing_wastes_little(docs, empty):
    got = packing.pack(docs).toPandas()
    assert 1 - got["length"].sum() / (1024 * got["sequence_id"].nunique()) < 0.03
    assert packing.pack(empty).count() == 0


def test_fast_ids_are_the_tokenizers_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k")
    rng = random.Random(5)
    pool = "abc XYZ 019 \n\t 　'’sS!?<|>é中\U0001f600́"
    for text in ["", " ", "<|endoftext|>", "a<|endoftext|>b", *["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]]:
        assert encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text


# WARC
PAGES = "page_id long, url string, html string, payload_digest string, refers_to string"


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>" + words(300, i % 9) + "</p>" for i in range(30)] + ["", None, "z" * 400_000, "\r\n\r\nWARC/1.1\r\n\r\n", "é中"]
    rows = [(i, f"http://x.example/{i}" if i % 5 else None, h, "clash", None) for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, rows[3], (None, "http://a b\r\nX: y", html[0], None, None)], PAGES)


def test_warc_round_trip(pages):
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=20_000)).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    payloads = [(r.html or "").encode() for r in rows]
    first = {}
    for r, p in zip(rows, payloads):
        if r.page_id is not None:
            first[p] = min(first.get(p, r.page_id), r.page_id)
    want = sorted(((r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if r.page_id == first[p] else "revisit", None if r.page_id == first[p] else first[p]) for r, p in zip(rows, payloads)), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    texts = {first[p]: p for p in payloads}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id in texts)


def test_small_payloads_are_all_responses(pages):
    got = warc.read_archives(warc.write_archives(pages, min_revisit_bytes=10**9))
    assert got.where("record_type = 'revisit'").count() == 0


def archive(records):
    import zstandard

    d = warc.train(records * 20, 4096)
    c = zstandard.ZstdCompressor(dict_data=d, write_checksum=True)
    return warc.leading_frame(d) + b"".join(c.compress(r) for r in records)


def test_the_reader_refuses_what_is_malformed():
    good = [warc.record(i, None, b"body %d" % i) for i in range(3)]
    data = archive(good)
    assert list(warc.ArchiveReader(io.BytesIO(data), 7)) == good
    for bad in (data[:-3], b"\x00" * 8 + data, data[:2], data[:-6] + b"\x00" * 6):
        with pytest.raises(warc.WarcError):
            list(warc.ArchiveReader(io.BytesIO(bad)))
    r = good[0]
    assert warc.parse_record(r)["payload"] == b"body 0"
    for bad in (r[:-1], r + b"x", r.replace(b"WARC/1.1", b"WARC/9.9"), r.replace(b"body 0", b"body 9"), r.replace(b"WARC-Date", b"X-Date"), r.replace(b"WARC-Type: response", b"WARC-Type: unknown"), r.replace(b"Content-Length: ", b"Content-Length: x", 1), b"", r.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_warc_of_nothing(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_ships_a_compressed_dictionary():
    import zstandard

    d = warc.train([b"some sample %d" % i for i in range(200)], 2048)
    packed = zstandard.ZstdCompressor().compress(d.as_bytes())
    frame = warc.SKIPPABLE_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    data = frame + zstandard.ZstdCompressor(dict_data=d).compress(b"x" * 50)
    assert list(warc.ArchiveReader(io.BytesIO(data))) == [b"x" * 50]
