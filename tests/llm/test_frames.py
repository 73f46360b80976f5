import random
import io
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from tokenizers import Tokenizer

from tidemark.llm.frames import ShardReader, ShardWriter, frame_of, read_documents, read_shards, write_shards
from tidemark.session import new_path

TOKENIZER = P.path("byte_bpe_50k.json")


def write(ids, width=2):
    out = io.BytesIO()
    writer = ShardWriter(out, width)
    packer = zstandard.ZstdCompressor(write_checksum=True)
    for key, x in ids:
        writer.append(key, *(lambda f, c: (f, len(x), c))(*frame_of(np.array(x, np.uint32), width, packer)))
    writer.close()
    return out.getvalue()


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_and_random_access(width):
    ids = [(i * 2, list(range(i % 7 * 100))) for i in range(50)] + [(98, [1, 2])]
    data = write(ids, width)
    reader = ShardReader(io.BytesIO(data), len(data))
    assert [reader.ids(i).tolist() for i in range(len(reader))] == [x for _, x in ids]
    assert [x.tolist() for x in reader.find(98)] == [ids[49][1], [1, 2]] and list(reader.find(3)) == []
    # The file as a whole is a valid run of zstandard frames.
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert np.frombuffer(plain, f"<u{width}").tolist() == [t for _, x in ids for t in x]


def test_only_the_asked_frame_is_read():
    data = write([(i, list(range(500))) for i in range(100)])

    class Counting(io.BytesIO):
        bytes_read = 0

        def read(self, size=-1):
            self.bytes_read += size
            return super().read(size)

    file = Counting(data)
    reader = ShardReader(file, len(data))
    file.bytes_read = 0
    assert reader.ids(40).tolist() == list(range(500))
    assert file.bytes_read == reader.ends[40] - reader.starts[40]


def test_damage_is_noticed():
    data = bytearray(write([(0, [5] * 9), (1, list(range(300)))]))
    reader = ShardReader(io.BytesIO(bytes(data)), len(data))
    data[int(reader.starts[1]) + 12] ^= 4
    reader = ShardReader(io.BytesIO(bytes(data)), len(data))
    assert reader.ids(0).tolist() == [5] * 9
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.ids(1)
    empty = write([])
    assert len(ShardReader(io.BytesIO(empty), len(empty))) == 0


def test_table(spark):
    rows = [(i * 37 % 101, f"some text {i} with <|endoftext|> and  spaces\n" * (i % 5), 1, "a") for i in range(101)]
    rows += [(200, None, 1, "a"), (7, "again seven", 2, "b"), (None, "no key", 2, "b"), (201, "long " * 90000, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, shard string").repartition(4)
    folder = new_path(spark, "tokens")
    manifest = write_shards(docs, TOKENIZER, folder, 5)
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    encode = lambda t: own.encode(t or "", add_special_tokens=False).ids + [2]
    got = sorted(read_shards(spark, manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    want = sorted((-1 if k is None else k, len(encode(t)), zlib.crc32(np.array(encode(t), "<u4").tobytes())) for k, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    shard = manifest.orderBy("shard").first()
    found = read_documents(f"{os.path.join(folder, shard.file)}", [7, 12345])
    assert {len(x) for x in found[7]} == {len(encode(t)) for k, t, *_ in rows if k == 7} and found[12345] == []
    assert write_shards(docs.limit(0), TOKENIZER, new_path(spark, "tokens"), 3).count() == 0


def test_pieces_encoded_together_and_a_cache_that_turns_over():
    from tokenizers import Tokenizer

    import public_tokenizers as tokenizers
    from tidemark.llm import frames

    path = tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    frames._cache.cache_clear()
    cache, _ = frames._cache(path)
    cache.limit = 400
    r = random.Random(1)
    parts = ["a", "foo", "Bär", "日本", " ", "  ", "\n", "\t", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "don't", "x1", "!!", "'s", "\r\n", "é", " q"]
    for _ in range(100):
        texts = ["".join(r.choice(parts) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(0, 30))) for _ in range(20)]
        texts.append(" ".join(f"w{r.randrange(10**6)}" for _ in range(200)))
        assert [x.tolist() for x in cache.ids([t.encode() for t in texts])] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    frames._cache.cache_clear()
