import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from attestry.llm import bpe_codec, packing, token_files
from attestry.llm.bpe import ByteBPE
from attestry.llm.common import work_dir
from attestry.llm.dac import Segment, encode_segment, segments
from attestry.llm.tokens import library_encoder, numpy_encoder, rank_encoder, vocabulary

BYTE, RANKS, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def hard_texts():
    rnd = random.Random(1)
    signs = [" ", "\n", "\t", "\xa0", "a", "b", "!", "1", "é", "́", "Σ", "　", "'s", "<|endoftext|>", "\x1c", "\x85", "aaaa"]
    signs_ = [chr(c) for c in [*range(0x20, 0x600), *range(0x2000, 0x2100), *range(0x3000, 0x3040)]]
    return ["", " ", "\n\n a", "a\t \tb", "aaaa aaaaa", "x<|endoftext|> y  <|endoftext|>\n", *("".join(rnd.choice(signs) for _ in range(rnd.randint(1, 30))) for _ in range(3000)), *("!" + c + "b " + c for c in signs_)]


@pytest.mark.parametrize("make, path, library", [(library_encoder, BYTE, BYTE), (numpy_encoder, BYTE, BYTE), (rank_encoder, RANKS, BYTE), (library_encoder, WORD, WORD)])
def test_ids_equal_the_library_on_whole_texts(make, path, library):
    texts = hard_texts()
    want = [e.ids for e in LIBRARY[library].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in make(path).encode(texts)] == want


def test_decoding_equals_the_library():
    model = ByteBPE(BYTE)
    for ids in ([], [50256, 220, 198], list(range(100, 400))):
        assert model.decode(ids) == LIBRARY[BYTE].decode(ids, skip_special_tokens=False)


def test_round_trip(odd_documents):
    rows = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe_codec.round_trip(odd_documents, BYTE).collect()}
    want = set()
    for r in odd_documents.collect():
        ids = LIBRARY[BYTE].encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), len(ids)))
    assert rows == want
    assert bpe_codec.round_trip(odd_documents.limit(0), BYTE).count() == 0
    decoded = bpe_codec.decode(bpe_codec.encode(odd_documents, BYTE), BYTE)
    assert sorted((r.doc_id or 0, r.text) for r in decoded.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd_documents.collect())


def test_codes_give_any_token_alone():
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, top, n).astype(np.uint32) for top, n in ((1, 5), (256, 1000), (65_536, 3000), (1 << 24, 2000), (1, 0), (300, 1))]
    flat = np.concatenate(docs)
    seg = Segment(encode_segment(3, 1, 77, [1, None, 3, 4, 5, 6], docs))
    assert (seg.shard, seg.number, seg.before, seg.n_ids, seg.doc_ids) == (3, 1, 77, len(flat), [1, None, 3, 4, 5, 6])
    assert [seg[i] for i in range(len(flat))] == flat.tolist()
    assert all((seg.document(k) == d).all() for k, d in enumerate(docs))
    for a, b in ((0, 0), (3, 9), (900, 4100), (5999, 6006)):
        assert (seg.slice(a, b) == flat[a:b]).all()
    two = encode_segment(0, 0, 0, [1], [flat]) + b"\n" + encode_segment(0, 1, 5, [2], [flat[:0]]) + b"\n"
    assert [s.n_ids for s in segments(two)] == [len(flat), 0]


def test_token_files(spark, odd_documents):
    path = work_dir(spark, "test-files")
    token_files.write(odd_documents, path, WORD, end_id=2, vocabulary_size=49_408, docs_per_shard=4, segment_ids=50)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect())
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.doc_id, r.text or "") for r in odd_documents.collect())
    want, start = [], 0
    for _, doc_id, text in rows:
        ids = [*LIBRARY[WORD].encode(text, add_special_tokens=False).ids, 2]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sorted(len(r.ids) for r in token_files.read(spark, path).collect()) == sorted(w[2] for w in want)


def test_packing(spark, odd_documents):
    pieces = packing.pack_documents(odd_documents.where("doc_id is null or doc_id <> 4")).toPandas()
    text = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    for doc_id, text_ in text.items():
        if doc_id == 4:
            continue
        ids = np.array([*LIBRARY[BYTE].encode(text_, add_special_tokens=False).ids, 1], "<u4")
        own = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id].sort_values("start")
        at = 0
        for p in own.itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        total = int(seq.length.sum())
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist()
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    assert packing.pack_documents(odd_documents.limit(0)).count() == 0


def test_related_documents_share_a_shard():
    """Copies have one kin; documents with a tenth of their ids changed mostly do, or one beside it."""
    rng = np.random.default_rng(8)
    cost = packing.costs(50_257)
    base = [rng.integers(0, 50_257, 300) for _ in range(400)]
    near = [np.where(rng.random(300) < 0.1, rng.integers(0, 50_257, 300), b) for b in base]
    kin = np.array([packing.kinship(x, cost) for x in [*base, *base, *near]])
    assert (kin[:400] == kin[400:800]).all()
    place = kin.argsort(kind="stable").argsort() // 64
    assert (place[:400] == place[800:]).mean() > 0.6 > 10 * np.mean(place[:400] == rng.permutation(place[800:]))
    assert packing.kinship(np.array([7]), cost) != packing.kinship(np.array([8]), cost) and packing.kinship(np.zeros(0, int), cost) == 0


def test_packing_needs_no_padding(spark, odd_documents):
    """Every row gives its pieces, those of a repeated doc_id too; sequences are whole windows or powers of two."""
    pieces = packing.pack_documents(odd_documents).toPandas()
    rows = odd_documents.collect()
    want = sum(len(LIBRARY[BYTE].encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    lengths = pieces.groupby("sequence_id").length.sum()
    assert lengths.sum() == want and all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    assert (pieces[pieces.doc_id == 4].start == 0).sum() == 2


def test_files_hold_every_byte(spark):
    """Ids whose codes are line feeds, carriage returns and bytes that are no UTF-8 come back from Spark's text files."""
    ids = np.array([10, 13, 0, 127, 128, 192, 255, 256 * 10 + 10, 256 * 255 + 254, 49_000] * 3, np.uint32)
    code = encode_segment(0, 0, 0, [1], [ids])
    path = work_dir(spark, "test-bytes")
    spark.createDataFrame([(bytearray(code),)] * 3, "value binary").selectExpr("cast(value as string) value").coalesce(1).write.text(path)
    content = spark.read.format("binaryFile").load(path).first().content
    assert [s.slice(0, len(ids)).tolist() for s in segments(bytes(content))] == [ids.tolist()] * 3


def test_windows_hold_related_documents():
    idf = np.ones(10, np.float32)
    docs = [np.array(x, np.uint32) for x in ([1, 1, 2, 9], [3, 3, 4, 9], [1, 2, 2, 9], [3, 4, 4, 9])]
    order = packing.fill_order(docs, packing.ShardIndex(docs, idf, 4.0), window=8, filled=0)
    assert order == [0, 2, 1, 3]
    assert packing.cuts(2048 * 2 + 13, 2048).tolist() == [2048, 4096, 4104, 4108, 4109]


def test_files_of_an_empty_table(spark, odd_documents, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(odd_documents.limit(0), path, WORD, end_id=2, vocabulary_size=49_408)
    got = token_files.digests(spark, path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0
    assert token_files.read(spark, path).columns == ["doc_id", "start", "ids"] and token_files.read(spark, path).count() == 0
