"""SAM and BAM (SRC5, SRC11, SRC12, SNK1 to SNK3)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S

COLUMNS = ("read_name", "flag", "ref_name", "pos", "mapq", "cigar", "seq", "qual", "tags")
SCHEMA = "read_name string, flag int, ref_name string, pos int, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>"


def records(df: DataFrame, tags: Mapping[str, str], name: str = "read_name", more: str | None = None) -> DataFrame:
    """Rows of SCHEMA from aligned rows (ref_name, ref_aln, read_aln, quals, ref_start) (SNK2, SNK3): no gaps, real qualities. tags: SAM tag to column; more: a
    column with a map of further ones."""
    own = F.map_filter(F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[F.col(c).cast("string") for c in tags.values()])), lambda k, v: v.isNotNull()) if tags else F.create_map().cast("map<string,string>")
    own = F.map_concat(own, F.col(more)) if more else own
    start = F.col("ref_start") if "ref_start" in df.columns else F.lit(0)
    qual = F.col("quals") if "quals" in df.columns else F.lit(None).cast("array<int>")
    return df.select(
        F.col(name).cast("string").alias("read_name"), F.lit(0).alias("flag"), "ref_name", (start + 1).cast("int").alias("pos"), F.lit(255).alias("mapq"),
        C.render(C.of_pair(F.col("ref_aln"), F.col("read_aln"))).alias("cigar"), S.strip_gaps(F.col("read_aln")).alias("seq"), qual.alias("qual"), own.alias("tags"),
    )


def write_sam(df: DataFrame, references: Sequence[tuple[str, int]], path: str, comment: str | None = None) -> None:
    """SAM text, a file a partition, each with the header (SNK1). references: (name, length), written in order of name."""
    head = ["@HD\tVN:1.6\tSO:unsorted", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in sorted(references)), *([f"@CO\t{comment}"] if comment else [])]
    qual = F.coalesce(F.array_join(F.transform("qual", lambda q: F.char(q + 33)), ""), F.lit("*"))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"]))
    fields = ["read_name", F.col("flag").cast("string"), F.coalesce("ref_name", F.lit("*")), F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", qual]
    line = F.concat_ws("\t", *fields, F.nullif(F.array_join(tags, "\t"), F.lit("")))

    def headed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    df.select(line.alias("value")).mapInArrow(headed, "value string").write.text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA; pos from 1."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(f.alias("f"))
    g = lambda i: F.get("f", i)
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(6), F.length(t)))))
    return rows.select(
        g(0).alias("read_name"), g(1).cast("int").alias("flag"), F.nullif(g(2), F.lit("*")).alias("ref_name"), g(3).cast("int").alias("pos"), g(4).cast("int").alias("mapq"), g(5).alias("cigar"),
        g(9).alias("seq"), F.when(g(10) != "*", F.transform(F.split(g(10), ""), lambda c: F.ascii(c) - 33)).alias("qual"), tags.alias("tags"),
    )


# -- BAM ---------------------------------------------------------------------------------------------------------------------------------
_CODES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\4\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """BGZF blocks of at most 60,000 bytes of content, and the empty block that ends a file."""
    held = b""
    for c in chunks:
        held += c
        while len(held) >= 60_000:
            yield _block(held[:60_000])
            held = held[60_000:]
    if held:
        yield _block(held)
    yield _block(b"")


def encode_record(r: Mapping, ids: Mapping[str, int]) -> bytes:
    """A BAM record of a row of SCHEMA; tags are strings."""
    import re

    ops = [(int(n), _OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"] or "")]
    seq = r["seq"] or ""
    codes = [_CODES.find(c) if c in _CODES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(r["qual"]) if r["qual"] else b"\xff" * len(seq)
    name = (r["read_name"] or "*").encode() + b"\0"
    pos, span = (r["pos"] or 0) - 1, sum(n for n, o in ops if o in (0, 2, 3, 7, 8)) or 1
    bin_ = next((base + (pos >> s) for base, s in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)) if pos >= 0 and pos >> s == (pos + span - 1) >> s), 0 if pos >= 0 else 4680)
    body = struct.pack("<iiBBHHHiiii", ids.get(r["ref_name"], -1), pos, len(name), r["mapq"] or 0, bin_, len(ops), r["flag"] or 0, len(seq), -1, -1, 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual
    for t, v in sorted(dict(r["tags"] or {}).items()):
        body += t.encode() + b"Z" + v.encode() + b"\0"
    return struct.pack("<i", len(body)) + body


def bam_header(references: Sequence[tuple[str, int]], comment: str | None = None) -> bytes:
    text = "".join(["@HD\tVN:1.6\tSO:unsorted\n", *(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in sorted(references)), *([f"@CO\t{comment}\n"] if comment else [])]).encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in sorted(references))
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references)) + refs


def write_bam(df: DataFrame, references: Sequence[tuple[str, int]], path: str, comment: str | None = None) -> list[str]:
    """A BAM file a partition under path (a URI that pyarrow's file systems know and all executors share); returns their names (SNK1)."""
    ids = {n: i for i, (n, _) in enumerate(sorted(references))}
    head = bam_header(references, comment)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"

        def chunks() -> Iterator[bytes]:
            yield head
            for batch in batches:
                for row in batch.to_pylist():
                    yield encode_record(row, ids)

        with store.open_output_stream(f"{base}/.{name}") as out:
            for block in bgzf(chunks()):
                out.write(block)
        store.move(f"{base}/.{name}", f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return [r[0] for r in df.select(*COLUMNS).mapInArrow(run, "name string").collect()]  # a row a partition


def _inflated(data: bytes) -> Iterator[bytes]:
    """Contents of the BGZF blocks, each checked; the size of a block is in its BC field."""
    at = 0
    while at < len(data):
        extra = struct.unpack_from("<H", data, at + 10)[0]
        field, size = at + 12, 0
        while field < at + 12 + extra:
            n = struct.unpack_from("<H", data, field + 2)[0]
            if data[field : field + 2] == b"BC":
                size = struct.unpack_from("<H", data, field + 4)[0] + 1
            field += 4 + n
        if not size:
            raise ValueError("no BGZF block")
        out = zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        if (zlib.crc32(out), len(out)) != struct.unpack_from("<II", data, at + size - 8):
            raise ValueError("damaged BGZF block")
        yield out
        at += size


def parse_bam(data: bytes) -> Iterator[dict]:
    """Rows of SCHEMA of a BAM file, block by block; an error where it is damaged."""
    blocks, held = _inflated(data), b""

    def need(n: int) -> bytes:
        nonlocal held
        while len(held) < n:
            try:
                held += next(blocks)
            except StopIteration:
                raise ValueError("the BAM file ends within a record") from None
        out, held = held[:n], held[n:]
        return out

    if need(4) != b"BAM\1":
        raise ValueError("no BAM file")
    need(struct.unpack("<i", need(4))[0])
    names = []
    for _ in range(struct.unpack("<i", need(4))[0]):
        names.append(need(struct.unpack("<i", need(4))[0])[:-1].decode())
        need(4)
    while True:
        while not held:
            try:
                held = next(blocks)
            except StopIteration:
                return
        b = need(struct.unpack("<i", need(4))[0])
        ref, pos, l_name, mapq, _, n_ops, flag, n = struct.unpack_from("<iiBBHHHi", b)
        at = 32 + l_name
        ops = struct.unpack_from(f"<{n_ops}I", b, at)
        at += 4 * n_ops
        packed, at = b[at : at + (n + 1) // 2], at + (n + 1) // 2
        qual, at = b[at : at + n], at + n
        yield {
            "read_name": b[32 : 31 + l_name].decode(), "flag": flag, "ref_name": names[ref] if ref >= 0 else None, "pos": pos + 1, "mapq": mapq, "cigar": "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*",
            "seq": "".join(_CODES[x >> 4] + _CODES[x & 15] for x in packed)[:n], "qual": None if qual[:1] == b"\xff" else list(qual), "tags": list(_tags(b, at).items()),
        }


def _tags(b: bytes, at: int) -> dict[str, str]:
    out, size = {}, {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at < len(b):
        key, kind, at = b[at : at + 2].decode(), chr(b[at + 2]), at + 3
        if kind in "ZH":
            end = b.index(0, at)
            out[key], at = b[at:end].decode(), end + 1
        elif kind == "B":
            one, n = size[chr(b[at])], struct.unpack_from("<i", b, at + 1)[0]
            out[key], at = ",".join(map(str, struct.unpack_from(f"<{n}{one}", b, at + 5))), at + 5 + n * struct.calcsize(one)
        else:
            value = struct.unpack_from("<" + size[kind], b, at)[0]
            out[key], at = value.decode() if kind == "A" else str(value), at + struct.calcsize(size[kind])
    return out


def read_bam(spark: SparkSession, path: str, ref_name: str | None = None) -> DataFrame:
    """Rows of SCHEMA of BAM files (SRC5); ref_name keeps one reference's. Files are read by Spark, one at a time in a task, so write many of moderate size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for r in parse_bam(data.as_py()):
                    if ref_name is None or r["ref_name"] == ref_name:
                        rows.append(r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("content").mapInArrow(run, schema)


def lineage_reads(bam: DataFrame, anchors: Sequence[str], least_rate: float, least_count: int) -> DataFrame:
    """Reads that pass FLT6 by their rm and rc tags (SRC11)."""
    from ..operators.filters import lineage_read

    tag = lambda t: F.element_at("tags", F.lit(t)).try_cast("double")
    return bam.where(F.map_contains_key("tags", "rm") & F.map_contains_key("tags", "rc")).where(lineage_read(F.col("seq"), tag("rm"), tag("rc"), anchors, least_rate, least_count))


def cells_of(bam: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(cell, reads, n) by tag values (SRC12)."""
    from ..operators.cells import reads_of_cells

    return reads_of_cells(bam.withColumn("cell", F.concat_ws(".", *[F.try_element_at("tags", F.lit(t)) for t in tags])), "cell", "read_name")
