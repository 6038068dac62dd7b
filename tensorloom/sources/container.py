"""Single-file binary container of tensors, as a Spark data source.

``spark.read.format("tensor_container").load(path)`` gives a record a tensor:
``(layer_idx, tensor_name, dtype, shape, is_iframe, vals)``. A filter on layer_idx or
tensor_name is pushed down to the partitions: only the blocks from the layer's
last I-frame on are read. ``verify=true`` checks the stored checksum first.

Writing takes ``(tensor_name, shape, vals)`` records. Every task codes its tensors
into a piece beside the target; the commit joins the pieces in name order.
Written tensors are I-frames; :func:`assemble` also takes delta frames.
"""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tensorloom.functions import codecs, streams

# Fixed values of the format.
MAGIC, VERSION = 0x534D4546, 1
HEADER_FORMAT = "<IHHIIIHHIIQQQQq18s"
HEADER_BYTES = 128
FLAG_DICT, FLAG_DELTA, FLAG_SPLIT, FLAG_CODED, FLAG_NATIVE = 1, 2, 4, 8, 16
TABLE_BYTES = 1280
LAYOUT_TAGS = ("fp32", "bf16", "fp16", "fp8")
PRECISION_BF16 = 1


@dataclass
class Header:
    """The fixed record at the start of a container."""

    magic: int = MAGIC
    version: int = VERSION
    arch_type: int = 0
    num_layers: int = 0
    num_atoms: int = 0
    atom_rank: int = 0
    orig_prec: int = PRECISION_BF16
    stored_prec: int = PRECISION_BF16
    flags: int = FLAG_DICT | FLAG_DELTA | FLAG_SPLIT | FLAG_CODED
    group_count: int = 0
    meta_offset: int = HEADER_BYTES
    dict_offset: int = 0
    layers_offset: int = 0
    seek_offset: int = 0
    checksum: int = 0
    reserved: bytes = b""

    def to_bytes(self) -> bytes:
        return struct.pack(HEADER_FORMAT, *(getattr(self, f.name) for f in fields(self))).ljust(HEADER_BYTES, b"\0")

    @classmethod
    def from_bytes(cls, data: bytes) -> Header:
        if len(data) < HEADER_BYTES:
            raise ValueError("container: header cut short")
        header = cls(*struct.unpack_from(HEADER_FORMAT, data))
        if header.magic != MAGIC:
            raise ValueError(f"container: bad magic {header.magic:#x}")
        if header.version != VERSION:
            raise ValueError(f"container: unknown version {header.version}")
        return header


def checksum(*sections: bytes) -> int:
    """First eight bytes of SHA-256 over the sections, little-endian, signed."""
    digest = hashlib.sha256()
    for section in sections:
        digest.update(section)
    return int.from_bytes(digest.digest()[:8], "little", signed=True)


def _sized(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def _take(source: io.BytesIO) -> bytes:
    (n,) = struct.unpack("<I", source.read(4))
    return source.read(n)


def join_block(is_iframe: bool, layout: str, r_shape: tuple, c_shape: tuple, shape: tuple, coded: dict) -> bytes:
    """One layer: marks, three shapes, the coded streams of R and C, and the tables' room on I-frames."""
    out = io.BytesIO()
    out.write(struct.pack("<BB", is_iframe, LAYOUT_TAGS.index(layout)))
    for s in (r_shape, c_shape, shape):
        if len(s) > 4:
            raise ValueError("this container holds tensors of four dimensions at most")
        out.write(struct.pack("<4IB", *s, *[0] * (4 - len(s)), len(s)))
    for part in ("R", "C"):
        for name in ("sign", "exp", "mant"):
            out.write(_sized(bytes(coded[part, name])))
    out.write(_sized(bytes(TABLE_BYTES) if is_iframe else b"") * 2)
    return out.getvalue()


def pack_block(is_iframe: bool, r: np.ndarray, c: np.ndarray, shape: tuple, backend: str = "lzma") -> bytes:
    """The block of a layer's arrays: split, coded by the backend, joined."""
    by = codecs.BACKENDS[backend]
    split = {"R": streams.split(r), "C": streams.split(c)}
    coded = {(part, name): codecs.codec(by[name])[0](split[part][name]) for part in split for name in by}
    return join_block(is_iframe, split["R"]["layout"], r.shape, c.shape, shape, coded)


def unpack_block(data: bytes, backend: str = "lzma") -> dict:
    """is_iframe, shape, and R and C as stored (deltas on P-frames), in float32."""
    source = io.BytesIO(data)
    is_iframe, tag = struct.unpack("<BB", source.read(2))
    shapes = []
    for _ in range(3):
        *dims, rank = struct.unpack("<4IB", source.read(17))
        shapes.append(tuple(dims[:rank]))
    by = codecs.BACKENDS[backend]
    out = {"is_iframe": bool(is_iframe), "shape": shapes[2], "layout": LAYOUT_TAGS[tag]}
    for part, shape in (("R", shapes[0]), ("C", shapes[1])):
        coded = {name: codecs.codec(by[name])[1](_take(source)) for name in ("sign", "exp", "mant")}
        out[part] = streams.widen(streams.merge(coded | {"layout": LAYOUT_TAGS[tag], "shape": shape}))
    return out


def pack_dictionaries(dictionaries: dict[int, np.ndarray]) -> bytes:
    body = b"".join(struct.pack("<III", m, *d.shape) + d.astype("<f4").tobytes() for m, d in dictionaries.items())
    return lzma.compress(body, preset=3) if dictionaries else b""


def unpack_dictionaries(data: bytes) -> dict[int, np.ndarray]:
    source, out = io.BytesIO(lzma.decompress(data) if data else b""), {}
    while head := source.read(12):
        m, rows, cols = struct.unpack("<III", head)
        out[m] = np.frombuffer(source.read(4 * rows * cols), "<f4").reshape(rows, cols)
    return out


def assemble(path: str, names: list[str], shapes: list, dtypes: list[str], groups: list[list[int]], blocks: Iterator[bytes], sizes: list[int], dictionaries: dict[int, np.ndarray] | None = None, backend: str = "lzma", flags: int = FLAG_DELTA | FLAG_SPLIT | FLAG_CODED, user: dict | None = None) -> int:
    """Write a container from its blocks, one at a time; returns its bytes.

    User metadata is kept apart under its own key and also merged last, where it
    does not clash with the format's own keys.
    """
    atoms = max((d.shape[1] for d in (dictionaries or {}).values()), default=0)
    own = {
        "tensor_names": names, "tensor_shapes": [list(s) for s in shapes], "tensor_dtypes": dtypes, "registry": {n: i for i, n in enumerate(names)}, "groups": groups,
        "entropy_backend": backend, "group_huffman_present": [], "num_atoms": atoms, "atom_rank": 0, "flags": flags | (FLAG_DICT if dictionaries else 0),
    }
    meta = lzma.compress(json.dumps({**(user or {}), **own, "user": user or {}}).encode(), preset=3)
    dictionary = pack_dictionaries(dictionaries or {})
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tolist()
    index = b"".join(struct.pack("<IIQ", g[0], len(g) - 1, offsets[g[0]]) for g in groups)
    header = Header(num_layers=len(names), num_atoms=atoms, flags=own["flags"], group_count=len(groups))
    header.dict_offset = HEADER_BYTES + 4 + len(meta)
    header.layers_offset = header.dict_offset + 4 + len(dictionary) + 4 + len(index)
    header.seek_offset = header.layers_offset + offsets[-1]
    digest = hashlib.sha256(meta + dictionary + index)
    with open(path, "wb") as f:
        f.write(header.to_bytes() + _sized(meta) + _sized(dictionary) + _sized(index))
        for block in blocks:
            digest.update(block)
            f.write(block)
        f.write(struct.pack(f"<{len(names)}Q", *offsets[:-1]))
        header.checksum = int.from_bytes(digest.digest()[:8], "little", signed=True)
        f.seek(0)
        f.write(header.to_bytes())
    return os.path.getsize(path)


class Container:
    """Random access to one file: metadata and the seek table on opening, blocks on demand."""

    def __init__(self, path: str, verify: bool = False):
        self.path = path
        with open(path, "rb") as f:
            self.header = Header.from_bytes(f.read(HEADER_BYTES))
            self.meta = json.loads(lzma.decompress(self._section(f, self.header.meta_offset)))
            self.dictionary_bytes = self._section(f, self.header.dict_offset)
            index = self._section(f, self.header.dict_offset + 4 + len(self.dictionary_bytes))
            end = os.path.getsize(path) - 8 * self.header.num_layers
            f.seek(end)
            offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
            if len(offsets) != self.header.num_layers or end < self.header.layers_offset:
                raise ValueError("container: cut short")
            self.starts = (self.header.layers_offset + offsets).tolist()
            self.stops = [*self.starts[1:], end]
            if verify:
                f.seek(self.header.meta_offset)
                meta = self._section(f, self.header.meta_offset)
                f.seek(self.header.layers_offset)
                if checksum(meta, self.dictionary_bytes, index, f.read(end - self.header.layers_offset)) != self.header.checksum:
                    raise ValueError("container: checksum does not match")
        self.backend = self.meta.get("entropy_backend", "lzma")
        self.names, self.shapes, self.dtypes = (self.meta[f"tensor_{k}"] for k in ("names", "shapes", "dtypes"))
        self.group_of = {layer: g for g, group in enumerate(self.meta["groups"]) for layer in group}

    @staticmethod
    def _section(f, offset: int) -> bytes:
        f.seek(offset)
        (n,) = struct.unpack("<I", f.read(4))
        return f.read(n)

    def dictionaries(self) -> dict[int, np.ndarray]:
        return unpack_dictionaries(self.dictionary_bytes) if self.meta.get("num_atoms") else {}

    def block(self, layer: int) -> dict:
        with open(self.path, "rb") as f:
            f.seek(self.starts[layer])
            return unpack_block(f.read(self.stops[layer] - self.starts[layer]), self.backend)

    def layers(self, wanted: list[int]) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(layer, is_iframe, array) of the wanted layers of one group, in order; holds one predecessor."""
        if not wanted:
            return
        group = self.meta["groups"][self.group_of[wanted[0]]]
        dictionaries = self.dictionaries()
        first = group.index(min(wanted))
        # Back to the I-frame on which the first wanted layer builds.
        with open(self.path, "rb") as f:
            while first:
                f.seek(self.starts[group[first]])
                if f.read(1) == b"\1":
                    break
                first -= 1
        last: dict | None = None
        for layer in group[first : group.index(max(wanted)) + 1]:
            now = self.block(layer)
            if not now["is_iframe"] and last is not None and now["R"].shape == last["R"].shape and now["C"].shape == last["C"].shape:
                now["R"], now["C"] = last["R"] + now["R"], last["C"] + now["C"]
            last = now
            if layer in wanted:
                yield layer, now["is_iframe"], self._whole(now, dictionaries, layer)

    def _whole(self, frame: dict, dictionaries: dict[int, np.ndarray], layer: int) -> np.ndarray:
        shape = tuple(self.shapes[layer])
        r = frame["R"]
        m = shape[0] if shape else 1
        if frame["C"].shape != (1, 1) and m in dictionaries:
            r = dictionaries[m] @ frame["C"] + r.reshape(m, -1)
        return r.reshape(shape).astype(np.float16 if self.dtypes[layer] == "float16" else np.float32)


SCHEMA = "layer_idx int, tensor_name string, dtype string, shape array<int>, is_iframe boolean, vals array<float>"


@dataclass
class _Layers(InputPartition):
    layers: list[int]


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.check = options["path"].removeprefix("file://"), str(options.get("verify", "false")).lower() == "true"
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = None
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in ("layer_idx", "tensor_name"):
                yield f
                continue
            if column == "tensor_name":
                names = names or Container(self.path).names
                values = [names.index(v) for v in values if v in names]
            self.wanted = set(values) if self.wanted is None else self.wanted & set(values)

    def partitions(self) -> list[InputPartition]:
        # A group is the unit of a task: its layers build on each other.
        file = Container(self.path, verify=self.check)
        picked = [[x for x in group if self.wanted is None or x in self.wanted] for group in file.meta["groups"]]
        return [_Layers(layers) for layers in picked if layers] or [_Layers([])]

    def read(self, partition: _Layers) -> Iterator[tuple]:
        file = Container(self.path)
        for layer, is_iframe, array in file.layers(partition.layers):
            yield layer, file.names[layer], file.dtypes[layer], list(file.shapes[layer]), is_iframe, array.astype(np.float32).reshape(-1).tolist()


@dataclass
class _Piece(WriterCommitMessage):
    path: str
    tensors: list[tuple]


class ContainerWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.backend = options["path"].removeprefix("file://"), options.get("backend", "lzma")
        codecs.BACKENDS[self.backend]
        self.at = {n: columns.index(n) for n in ("tensor_name", "shape", "vals")}
        # Pieces lie beside the target, on the storage that all executors share.
        self.pieces = f"{self.path}.pieces-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Piece:
        os.makedirs(self.pieces, exist_ok=True)
        path, tensors = f"{self.pieces}/{uuid.uuid4().hex}", []
        with open(path, "wb") as f:
            for row in iterator:
                name, shape, vals = (row[self.at[n]] for n in ("tensor_name", "shape", "vals"))
                array = np.array(vals, np.float32).reshape(shape)
                m = shape[0] if shape else 1
                block = pack_block(True, array.reshape(m, -1) if array.size else array.reshape(0, 0), np.zeros((1, 1), np.float32), tuple(shape), self.backend)
                tensors.append((name, list(shape), f.tell(), len(block)))
                f.write(block)
        return _Piece(path, tensors)

    def commit(self, messages: list[_Piece | None]) -> None:
        found = sorted((t[0], t[1], m.path, t[2], t[3]) for m in messages if m for t in m.tensors)

        def blocks() -> Iterator[bytes]:
            for _, _, path, at, size in found:
                with open(path, "rb") as f:
                    f.seek(at)
                    yield f.read(size)

        names = [t[0] for t in found]
        if len(set(names)) < len(names):
            raise ValueError("container: a tensor name occurs twice")
        assemble(self.path, names, [t[1] for t in found], ["float32"] * len(found), [[i] for i in range(len(found))], blocks(), [t[4] for t in found], backend=self.backend, flags=FLAG_SPLIT | FLAG_CODED)
        shutil.rmtree(self.pieces, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.pieces, ignore_errors=True)


class TensorContainer(DataSource):
    """The data source ``tensor_container``."""

    @classmethod
    def name(cls) -> str:
        return "tensor_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter pushdown."""
    spark.dataSource.register(TensorContainer)
    spark.udtf.register("tl_unpack_block", UnpackBlock)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def describe(spark: SparkSession, path: str):
    """``(layer_idx, tensor_name, dtype, shape, group_id, seek_offset, block_len)`` without reading a block."""
    file = Container(path)
    rows = [(i, n, file.dtypes[i], [int(x) for x in file.shapes[i]], file.group_of[i], file.starts[i] - file.header.layers_offset, file.stops[i] - file.starts[i]) for i, n in enumerate(file.names)]
    return spark.createDataFrame(rows, "layer_idx int, tensor_name string, dtype string, shape array<int>, group_id int, seek_offset long, block_len long")


@udtf(returnType="part string, stream string, codec string, raw_len int, blob binary")
class UnpackBlock:
    """SQL table function ``tl_unpack_block(block, backend)``: a row for each stream of a layer block, still coded."""

    def eval(self, block: bytes, backend: str) -> Iterator[tuple]:
        source, by = io.BytesIO(bytes(block)), codecs.BACKENDS[backend]
        source.seek(2 + 3 * 17)
        for part in ("R", "C"):
            for name in ("sign", "exp", "mant"):
                blob = _take(source)
                yield part, name, by[name], len(codecs.codec(by[name])[1](blob)), blob
