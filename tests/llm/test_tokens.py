import brute
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weirline.llm import token_files
from weirline.llm.token_files import BLOCK, FileReader, FileWriter, TextEncoder, WordEncoder, pack_block, unpack_block

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 1 << 31, 1 << 52, 1 << 64])
def test_blocks_come_back(top):
    draw = np.random.default_rng(0)
    for n in (0, 1, 7, 61, 1000):
        ids = draw.integers(0, top, n, dtype=np.uint64, endpoint=False) if top < 1 << 64 else draw.integers(0, (1 << 64) - 1, n, dtype=np.uint64)
        ids[::3] = np.minimum(ids[::3], np.uint64(1))
        words = pack_block(ids)
        assert unpack_block(words, n).tolist() == ids.tolist()
        if top <= 2:
            assert len(words) <= n // 60 + 1


def test_files_come_back(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * BLOCK + 5).astype(np.uint64)
    path = f"{tmp_path}/one.ids"
    file = FileWriter(pa.fs.LocalFileSystem().open_output_stream(path))
    cuts = [0, 10, 10, BLOCK + 3, len(ids)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        file.add(pa.array([k or None], pa.int64()), np.array([b - a]), ids[a:b])
    assert file.close() == (4, len(ids))
    back = FileReader(path)
    assert back.doc_ids.to_pylist() == [None, 1, 2, 3] and back.lengths.tolist() == np.diff(cuts).tolist()
    for a, b in [(0, len(ids)), (5, 6), (BLOCK - 1, BLOCK + 1), (2 * BLOCK, 2 * BLOCK), (BLOCK, 3 * BLOCK + 5)]:
        assert (back.ids(a, b) == ids[a:b]).all()


ODD = ["", None, "It's A-b_c!? 'll x'y", "á É İİ K", "\x00 a\x00b", "<|endoftext|> <|ENDOFTEXT|>x", "  z\t\n", "Σς straße 12ab3", "...a...b,c"]


@pytest.mark.parametrize("texts", [ODD, *[[t] for t in ODD if t]])
def test_words_encode_like_whole_texts(texts):
    tokenizer = Tokenizer.from_file(PATH)
    true = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for encoder in (WordEncoder(PATH, 2), TextEncoder(PATH, 2)):
        for _ in range(2):
            lengths, ids = encoder(pa.array(texts, pa.string()))
            assert np.split(ids, np.cumsum(lengths)[:-1])[0].tolist() == true[0]
            assert ids.tolist() == sum(true, []) and lengths.tolist() == list(map(len, true))


COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_given_table(spark, sf_dir, rows):
    found = sorted(tuple(r) for r in token_files.report(spark, sf_dir).select(*COLUMNS).collect())
    assert found == brute.token_rows(rows, Tokenizer.from_file(PATH))


def test_odd_texts_over_many_files(odd, odd_rows, empty, repeated):
    manifest = token_files.write_ids(odd, PATH, file_ids=1000)
    assert manifest.count() > 3
    found = token_files.read_ids(manifest)
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == brute.token_rows(odd_rows, Tokenizer.from_file(PATH))
    assert token_files.read_ids(token_files.write_ids(empty, PATH)).count() == 0
    again = token_files.read_ids(token_files.write_ids(repeated, PATH)).orderBy("start").collect()
    assert [r.doc_id for r in again] == [None, None, None, 1, 1, 2, 2]
    assert [r.start for r in again] == [sum(x.n_tokens for x in again[:k]) for k in range(len(again))]
