"""WARC salvage, progressive JPEG, byte-level BPE and reply trees: round trips and brute force."""

import gzip
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusradar.llm import byte_bpe, reply_trees, warc
from corpusradar.llm import progressive_jpeg as jpeg

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- WARC ------------------------------------------------------------------------------------------------------------

class Memory:
    def __init__(self, octets):
        self.octets = octets

    def read_at(self, n, at):
        return self.octets[at:at + n]


def walked(octets):
    return list(warc.Archive(Memory(octets), len(octets)).walk())


def archive(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, value string, digest string")
    path = str(tmp_path / "archive")
    warc.write_archives(warc.records(df, "page_id", "url", "html", **options).coalesce(1), path)
    return path


PAGES = [(1, "http://a/1", "<p>é WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n</p>"), (2, "http://a/2\r\nX: y", ""), (3, None, None),
         (4, "http://a/4", "x" * 300_000), (5, "u", "x" * 300_000), (6, "u", "last"), (6, "u", "last"), (None, "u", "last")]
PAGES = [(*p, "clash", "clash") for p in PAGES]


def test_pages_come_back_and_repeats_become_revisits(spark, tmp_path):
    path = archive(spark, tmp_path, PAGES)
    got = warc.read_archives(spark, path).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(PAGES)
    types = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert types == sorted([
        ("<urn:page:1>", "response", None, len(PAGES[0][2].encode())), ("<urn:page:2>", "response", None, 0),
        ("<urn:page:3>", "revisit", "<urn:page:2>", 0), ("<urn:page:4>", "response", None, 300_000),
        ("<urn:page:5>", "revisit", "<urn:page:4>", 300_000), ("<urn:page:6>", "response", None, 4), ("<urn:page:6>", "response", None, 4),
        ("<urn:page:none>", "revisit", "<urn:page:6>", 4)])
    texts = {r.record_id: r.payload for r in got if r.record_type == "response"}
    assert texts["<urn:page:1>"].decode() == PAGES[0][2]


def test_small_payloads_may_stay_responses(spark, tmp_path):
    got = warc.read_archives(spark, archive(spark, tmp_path, PAGES, min_bytes=5)).collect()
    assert sum(r.record_type == "revisit" for r in got) == 1


def test_no_pages_no_records(spark, tmp_path):
    assert warc.read_archives(spark, archive(spark, tmp_path, [])).count() == 0


def record(i, payload=b"hello"):
    import base64
    import hashlib

    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = [b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:%d>" % i, b"WARC-Payload-Digest: sha1:" + digest,
            b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def found(octets):
    steps = walked(octets)
    assert [s[1] for s in steps[1:]] == [s[2] for s in steps[:-1]] and (not steps or (steps[0][1], steps[-1][2]) == (0, len(octets)))
    return [s[3]["record_id"] for s in steps if s[0] == "record"], [(s[1], s[2]) for s in steps if s[0] == "gap"]


def test_headers_of_any_length(spark, tmp_path):
    rows = [(1, "http://a/" + "u" * (2 << 20), "<p>one</p>"), (2, "http://b/\r\nx", None), (3, None, ""), (4, "http://c/", "<p>one</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.query(spark, str(tmp_path)).collect()}
    assert got == {1: (10, "response", None), 2: (0, "response", None), 3: (0, "revisit", 2), 4: (10, "revisit", 1)}


def test_false_starts_are_left_early():
    reads = []
    body = b"WARC/1.0\r\nbroken line\r\n" * 3000

    def read(at, n):
        reads.append(n)
        return body[at:at + n]

    with pytest.raises(warc.Damaged, match="colon"):
        warc.parse(read, 0, len(body))
    assert reads == [4096]


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_one_record(packed):
    parts = [record(i, b"payload %d " % i * 50) for i in range(5)]
    if packed:
        parts = [gzip.compress(p, mtime=0) for p in parts]
    whole = b"".join(parts)
    at = len(parts[0]) + len(parts[1])
    for place in (0, 1, len(parts[2]) // 2, len(parts[2]) - 3):
        broken = bytearray(whole)
        broken[at + place] ^= 0x55
        names, gaps = found(bytes(broken))
        assert names == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)] and gaps == [(at, at + len(parts[2]))]


def test_cut_front_and_end_and_garbage():
    one, two = record(1), record(2)
    assert found(one[10:] + two) == (["<urn:page:2>"], [(0, len(one) - 10)])
    assert found(one + two[:-1]) == (["<urn:page:1>"], [(len(one), len(one) + len(two) - 1)])
    assert found(one + b"\x1f\x8b\x08 garbage WARC/1.1 x\nWARC/1.0\r\n" + two)[0] == ["<urn:page:1>", "<urn:page:2>"]
    assert found(b"") == ([], []) and found(b"nothing")[1] == [(0, 7)]


def test_gaps_are_logged_in_the_table(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + b"junk" * 10 + record(2))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.kind, r.end - r.start) for r in rows if r.kind == "gap"] == [("gap", 40)] and rows[1].reason
    assert [r.payload for r in rows if r.kind == "record"] == [b"hello", b"hello"]


# ---- progressive JPEG ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [192, 384, 576, 1344, 192 * 333, jpeg.FRAME_BYTES + 192])
def test_payloads_come_back(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    left, out = n, b""
    for frame, _ in jpeg.decode(jpeg.encode(payload)):
        part = jpeg.kept_bytes(frame)[:min(left, jpeg.FRAME_BYTES)].tobytes()
        out, left = out + part, left - len(part)
    assert out == payload


class Writer:
    """A plain bit-by-bit progressive coder, for coefficients of any kind."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def sized(value):
    n = abs(value).bit_length()
    return n, value if value >= 0 else value + (1 << n) - 1


def code(writer, symbol):
    writer.put(ALPHABET.index(symbol), 9)


ALPHABET = [r << 4 | s for r in range(16) for s in range(12)]


def first_pass(blocks, first, last, low):
    """AC first pass with runs of blocks and runs of sixteen zeros."""
    writer, waiting = Writer(), 0

    def flush():
        nonlocal waiting
        if waiting:
            power = waiting.bit_length() - 1
            code(writer, power << 4)
            writer.put(waiting - (1 << power), power)
            waiting = 0

    for block in blocks:
        values = [int(np.sign(v)) * (abs(int(v)) >> low) for v in block[first:last + 1]]
        ends = max([i for i, v in enumerate(values) if v], default=-1)
        run = 0
        for v in values[:ends + 1]:
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                code(writer, 0xF0)
                run -= 16
            n, extra = sized(v)
            code(writer, run << 4 | n)
            writer.put(extra, n)
            run = 0
        if ends < len(values) - 1:
            waiting += 1
    flush()
    return writer.done()


def refine_pass(blocks, first, last, low):
    """AC refinement, block by block (each ends its own run)."""
    writer = Writer()
    for block in blocks:
        sizes = [abs(int(v)) >> low for v in block[first:last + 1]]
        fresh = [i for i, v in enumerate(sizes) if v == 1]
        ends, run, corrections = max(fresh, default=-1), 0, []
        for i, v in enumerate(sizes[:ends + 1]):
            if v == 0:
                run += 1
                if run > 15 and any(j > i for j in fresh):
                    code(writer, 0xF0)
                    for c in corrections:
                        writer.put(c, 1)
                    run, corrections = run - 16, []
            elif v > 1:
                corrections.append(v & 1)
            else:
                code(writer, run << 4 | 1)
                writer.put(int(block[first + i] > 0), 1)
                for c in corrections:
                    writer.put(c, 1)
                run, corrections = 0, []
        if ends < len(sizes) - 1:
            code(writer, 0)
            for v in sizes[ends + 1:]:
                if v > 1:
                    writer.put(v & 1, 1)
    return writer.done()


def table(kind):
    counts = [len(ALPHABET) if i == 9 else 0 for i in range(1, 17)]
    return jpeg._segment(0xC4, bytes([kind << 4, *counts, *ALPHABET]))


def scan(first, last, high, low, data):
    return jpeg._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + data


@pytest.mark.parametrize("seed", range(6))
def test_any_progressive_image_of_one_component(seed):
    draw = np.random.default_rng(seed)
    blocks = np.where(draw.random((12, 64)) < draw.choice([0.05, 0.3, 0.9]), draw.integers(-60, 61, (12, 64)), 0)
    blocks[3] = 0
    dc = Writer()
    last = 0
    for block in blocks:
        n, extra = sized((int(block[0]) >> 1) - last)
        last = int(block[0]) >> 1
        code(dc, n)
        dc.put(extra, n)
    low_bits = Writer()
    for block in blocks:
        low_bits.put(int(block[0]) & 1, 1)
    parts = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0, *[3] * 64])), jpeg._segment(0xC2, bytes([8, 0, 23, 0, 32, 1, 1, 0x11, 0])), table(0), table(1),
             scan(0, 0, 0, 1, dc.done()), scan(1, 9, 0, 2, first_pass(blocks, 1, 9, 2)), scan(10, 63, 0, 2, first_pass(blocks, 10, 63, 2)),
             scan(1, 63, 2, 1, refine_pass(blocks, 1, 63, 1)), scan(1, 63, 1, 0, refine_pass(blocks, 1, 63, 0)), scan(0, 0, 1, 0, low_bits.done()),
             b"\xff\xd9"]
    frame, quantisers, _ = jpeg.decode_frame(b"".join(parts))
    assert (frame.components[0].coefficients == blocks).all()
    image = frame.rgb(quantisers)
    assert image.shape == (23, 32, 3) and (image[..., 0] == image[..., 2]).all()
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = blocks[1] * 3
    u = np.arange(8)
    cosine = np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    want = np.clip(np.rint(cosine.T @ natural.reshape(8, 8) @ cosine + 128), 0, 255)
    assert np.abs(image[:8, 8:16, 0].astype(int) - want).max() <= 1


def test_zigzag_and_broken_images():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))
    media = jpeg.encode(b"a" * 192)
    for broken in (media[:50], b"xx" + media, media[:-40]):
        with pytest.raises(ValueError):
            list(jpeg.decode(broken))


def test_texts_as_images(spark):
    texts = ["", None, "é" * 500, "a" * 192, "a" * 193, "a" * 192, "z" * (jpeg.FRAME_BYTES + 5)]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    media = jpeg.store_texts(df)
    got = {r.doc_id: r for r in jpeg.stored_features(media).collect()}
    import hashlib
    import zlib

    for i, t in enumerate(texts):
        octets = (t or "").encode()
        payload = octets.ljust(max(192, -(-len(octets) // 192) * 192))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(octets), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-16:])
    assert got[3][3:] == got[5][3:] and got[0][3:] == got[1][3:]
    sizes = {(r.doc_id, r.frame): len(r.tensor) == r.height * r.width * 3 for r in jpeg.tensors(media).collect()}
    assert all(sizes.values()) and (6, 1) in sizes and jpeg.stored_features(media.where("doc_id < 0")).count() == 0


# ---- byte-level BPE --------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.read_ranks(RANKS)
    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN, offsets=True), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4), st.lists(st.text(alphabet="ab \n'st12éá—", max_size=60), max_size=4))
def test_ids_are_those_of_the_other_library(both, some, more):
    codec, other = both
    texts = some + more
    ids, bounds, spans = codec.encode(texts)
    for i, text in enumerate(texts):
        mine = slice(bounds[i], bounds[i + 1])
        assert ids[mine].tolist() == other.encode_ordinary(text)
        begin, end = spans[:, mine]
        covered = sorted(set().union(*[range(a, b) for a, b in zip(begin, end, strict=True)]))
        assert covered == list(range(len(text)))
    assert [x.decode() for x in codec.decode(ids, bounds)] == texts


def test_every_character_and_small_memory():
    ranks = byte_bpe.read_ranks(RANKS)
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN, most_pieces=3)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for part in (text, "a b c d e f", "<|endoftext|> <|im_start|>"):
        ids, bounds, _ = codec.encode([part])
        assert ids.tolist() == other.encode_ordinary(part) and codec.decode(ids, bounds)[0].decode() == part


def test_tables_of_ids(spark):
    texts = ["hello world", None, "", "日本語 é", "hello world", "x" * 50_000]
    df = spark.createDataFrame([(i, t, [1], "c") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, piece string")
    ids = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    rows = {r.doc_id: r for r in ids.collect()}
    assert rows[1].ids == [] and rows[0].ids == rows[4].ids and rows[3].ends[-1] == 5
    split = spark.createDataFrame([(1, rows[3].ids[:1]), (2, None), (3, rows[3].ids)], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in byte_bpe.decode(split, RANKS, public_tokenizers.PATTERN).collect()}
    assert texts[2] == "" and texts[3] == "日本語 é"
    assert byte_bpe.encode(df.where("doc_id > 99"), RANKS, public_tokenizers.PATTERN).count() == 0


# ---- reply trees -----------------------------------------------------------------------------------------------------

TREE = "tree long, id long, parent long, score double, role string, text string, turns string, leaf string"


def test_paths_of_random_trees(spark):
    draw = random.Random(5)
    rows = []
    for tree in [1, 2, 3, None]:
        for i in range(40):
            parent = None if i == 0 else draw.randrange(max(0, i - 3), i)
            rows.append((tree, i, parent, draw.random(), draw.choice(["user", "assistant", None]), f"t{i} <|im_end|>", "c", "c"))
    rows += [(9, i, i - 1, 1.0, "user", "chain", None, None) for i in range(1, 131)]  # the parent of the first does not exist
    rows += [(10, 1, 2, 1.0, "user", "cycle", None, None), (10, 2, 1, 1.0, "user", "cycle", None, None), (10, 3, 1, 1.0, "user", "below", None, None)]
    df = spark.createDataFrame(rows, TREE)
    want = {}
    for tree in {r[0] for r in rows} - {10}:
        up = {r[1]: r[2] for r in rows if r[0] == tree}
        score = {r[1]: r[3] for r in rows if r[0] == tree}
        paths = []
        for leaf in set(up) - set(up.values()):
            path = [leaf]
            while up.get(path[-1]) in up:
                path.append(up[path[-1]])
            paths.append((-sum(map(score.get, path)) / len(path), leaf, path[::-1]))
        want |= {(tree, leaf): (path, branch) for branch, (_, leaf, path) in enumerate(sorted(paths), 1)}
    got = {}
    for r in reply_trees.chosen_paths(df.select("tree", "id", "parent", "score"), None).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.position, r.id, r.branch))
    assert {k: ([i for _, i, _ in sorted(v)], v[0][2]) for k, v in got.items()} == want
    best = reply_trees.formatted(df).collect()
    assert {(r.tree, r.leaf) for r in best} == {k for k, (_, branch) in want.items() if branch == 1}


def test_template_and_mask_are_reversible(spark):
    texts = ["<|im_end|>", "<\\|im_start|>", "a<\\\\|b", "", None, "\n<|im_start|>user\nx", "plain <| \\ |>", "é" * 1000]
    rows = [(1, i + 1, i, 1.0, "assistant" if i % 2 else "us er\n<|", t, None, None) for i, t in enumerate(texts)]
    r = reply_trees.read_back(reply_trees.formatted(spark.createDataFrame(rows, TREE))).first()
    assert [(t.role, t.text) for t in r.turns] == [(x[4], x[5] or "") for x in rows]
    assert r.loss_texts == [t or "" for i, t in enumerate(texts) if i % 2]
    masked = [r.formatted[s.begin:s.end] for s in r.loss_spans]
    assert len(masked) == 4 and masked[3] == "é" * 1000 and "<|" not in "".join(masked)


def test_empty_messages(spark):
    assert reply_trees.formatted(spark.createDataFrame([], TREE)).count() == 0


def test_threads_with_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 3, None, None), (1, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: [t.text for t in r.turns] for r in reply_trees.read_back(reply_trees.formatted(reply_trees.threads(df))).collect()}
    assert got == {1: ["first", "a", "a", "b"], None: [""]}
