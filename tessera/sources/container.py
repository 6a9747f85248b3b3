"""Byte-level sources: signatures, container boxes, sections and codestream parts, over a binary column or spark.read.format("binaryFile")."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.arrow import map_rows
from tessera.relational import Operator

CONTAINER = bytes.fromhex("0000000C4A584C200D0A870A")
_S1 = "hex(substring(content, 1, 12)) h"


def signature(content: DataFrame) -> DataFrame:
    """(doc_id, content) to (doc_id, kind): codestream, container, none, or more where the bytes so far could still become one."""
    h = F.hex(F.substring("content", 1, 12))
    whole = CONTAINER.hex().upper()
    kind = F.when(h.startswith("FF0A"), "codestream").when(h == whole, "container").when((F.length(h) < 24) & (F.lit(whole).startswith(h) | F.lit("FF0A").startswith(h)), "more").otherwise("none")
    return content.select("doc_id", kind.alias("kind"))


SIGNATURE_SQL = f"with h as (select doc_id, substr(hex(content), 1, 24) h from {{contents}}) select doc_id, case when starts_with(h, 'FF0A') then 'codestream' when h = '{CONTAINER.hex().upper()}' then 'container' when length(h) < 24 and (starts_with('{CONTAINER.hex().upper()}', h) or starts_with('FF0A', h)) then 'more' else 'none' end kind from h"


def boxes(content: bytes | None) -> Iterator[tuple[str, int, int]]:
    """(type, offset, length) of a container's boxes; size 0 reaches to the end, size 1 has 64 bits. Ends at the first broken header."""
    b, at = content or b"", 0
    while at + 8 <= len(b):
        size, kind, head = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= len(b):
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        size = len(b) - at if size == 0 else size
        if size < head or at + size > len(b):
            return
        yield kind.decode("latin-1"), at + head, size - head
        at += size


def events(content: bytes | None) -> Iterator[tuple[str, str, int, int]]:
    """(event, name, offset, length) as a parser meets them: the kind of the file, parts of the codestream, other boxes; and `invalid` where
    a part can't follow what came before: parts count from 0, the last one says so, and a whole stream stands alone."""
    b = content or b""
    if b[:2] == b"\xff\x0a":
        yield "kind", "codestream", 0, len(b)
        yield "codestream", "", 0, len(b)
        return
    if b[:12] != CONTAINER:
        yield "kind", "none", 0, len(b)
        return
    yield "kind", "container", 0, len(b)
    wanted: int | None = 0  # the next part, none after the last one
    for name, at, n in boxes(b):
        if name not in ("jxlc", "jxlp"):
            yield "aux", name, at, n
            continue
        part = int.from_bytes(b[at : at + 4], "big") if name == "jxlp" else 0
        if (wanted != 0) if name == "jxlc" else (n < 4 or wanted is None or part & 0x7FFFFFFF != wanted):
            yield "invalid", name, at, n
            return
        wanted = None if name == "jxlc" or part >> 31 else wanted + 1
        head = 4 if name == "jxlp" else 0
        yield "codestream", name, at + head, n - head


def codestream(content: bytes | None) -> bytes:
    """A bare stream as it is, or the parts of a container's stream, up to a part that can't be."""
    return b"".join((content or b"")[at : at + n] for event, _, at, n in events(content) if event == "codestream")


def event_table(content: DataFrame) -> DataFrame:
    """(doc_id, content) to (doc_id, seq, event, name, offset, length)."""

    def rows_of(cols):
        for i, c in zip(cols["doc_id"], cols["content"]):
            for seq, e in enumerate(events(c)):
                yield i, seq, *e

    return map_rows(content.select("doc_id", "content"), rows_of, "doc_id long, seq int, event string, name string, offset long, length long")


def codestreams(content: DataFrame) -> DataFrame:
    """(doc_id, content) to (doc_id, stream)."""
    return map_rows(content.select("doc_id", "content"), lambda cols: ((i, codestream(c)) for i, c in zip(cols["doc_id"], cols["content"])), "doc_id long, stream binary")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, content) of the files under a path, whole (Spark passes over empty ones); a reader's position, skips and parts are those of bitstream.bits.Bits."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def box_table(content: DataFrame) -> DataFrame:
    """(doc_id, content) to (doc_id, box, offset, length)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(i, *x) for i, c in zip(batch["doc_id"].to_pylist(), batch["content"].to_pylist()) for x in boxes(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "box", "offset", "length"])

    return content.select("doc_id", "content").mapInArrow(run, "doc_id long, box string, offset long, length long")


class BitReader:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.value, self.bits, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def peek(self, n: int) -> int:
        return (self.value >> self.at) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.bits:
            raise EOFError("not enough bits")
        out = self.peek(n)
        self.at += n
        return out

    def align(self) -> None:
        """To the next byte; skipped bits must be 0."""
        if self.at % 8 and self.read(8 - self.at % 8):
            raise ValueError("padding is not zero")


OPERATORS = {
    "s6_fixed_bits": Operator("S6", "with b as (select k, l, c0*4096+c1*64+c2 w from {pix}) select k, l, cast(w & 15 as int) b0, cast((w >> 4) & 7 as int) b4, cast((w >> 7) & 255 as int) b7 from b", ("pix",)),
    "s8_frame_sizes": Operator("S8", "with f as (select frame, count(distinct y) h, max(x)+1 w from {frames} group by frame) select frame, w, h, cast((w+7) @div 8 as bigint) blocks_x, cast((h+7) @div 8 as bigint) blocks_y, cast((w+255) @div 256 as bigint) groups_x, cast((h+255) @div 256 as bigint) groups_y from f", ("frames",)),
    "s9_section_offsets": Operator("S9", "select event_id, grp, len, cast(sum(len) over (partition by grp order by event_id rows unbounded preceding) - len as bigint) off from {sections}", ("sections",)),
    "s10_section_kinds": Operator("S10", "with s as (select event_id, grp, pass from {sections}) select event_id, case when pass = 0 then 'lf_global' when pass <= 2 then 'lf' when pass = 3 then 'hf_global' else 'hf' end kind, case when pass = 0 then 0 when pass <= 2 then pass when pass = 3 then 3 else 4 + 16*(pass-4) + grp end idx from s", ("sections",)),
    "s12_inspect": Operator("S12", "select grp, count(*) frames, sum(len)*1000e0/30e0 ms, cast(sum(len) as bigint) bytes, cast(max(pass)+1 as bigint) passes from {sections} group by grp", ("sections",)),
    "t3_section_order": Operator("T3", "select event_id, grp, cast(row_number() over (partition by grp order by case when pass = 0 then 0 when pass <= 2 then 1 when pass = 3 then 2 else 3 end, pass, event_id) as int) decode_order from {sections}", ("sections",)),
    "f11_md5": Operator("F11", "select doc_id, md5(content) digest from {contents}", ("contents",)),
}


def s1_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.views import contents

    return signature(contents(spark, sf_dir))


def _be(n, digits: int = 8):
    return F.unhex(F.lpad(F.hex(n.cast("long")), digits, "0"))


def s3_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in a container of its own, walked again: boxes of 32 and 64 bits of size, and to the end of the file."""
    from tessera.sources.views import read

    text = F.col("text").cast("binary")
    n, kind = F.length(text), F.col("doc_id") % 3
    head = F.when(kind == 0, F.concat(_be(n + 8), F.lit(b"jxlc"))).when(kind == 1, F.concat(F.lit(b"\0\0\0\1jxlc"), _be(n + 16, 16))).otherwise(F.lit(b"\0\0\0\0jxlc"))
    return box_table(read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(CONTAINER), head, text).alias("content")))


def _in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in two parts around a box of metadata; every third says a wrong number in its second part."""
    from tessera.sources.views import read

    text = F.col("text").cast("binary")
    half = F.expr("octet_length(text) div 2")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.octet_length("text") - half)
    index = F.when(F.col("doc_id") % 3 == 0, F.lit(b"\x80\0\0\2")).otherwise(F.lit(b"\x80\0\0\1"))
    parts = F.concat(F.lit(CONTAINER), _be(half + 12), F.lit(b"jxlp\0\0\0\0"), first, F.lit(b"\0\0\0\x0dExifhello"), _be(F.length(second) + 12), F.lit(b"jxlp"), index, second)
    return read(spark, sf_dir, "documents").select("doc_id", parts.alias("content"))


def s4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(_in_parts(spark, sf_dir))


def s5_codestreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codestreams(_in_parts(spark, sf_dir)).select("doc_id", F.octet_length("stream").alias("n"), F.md5("stream").alias("digest"))


_T = "select doc_id, octet_length(encode(text)) n, octet_length(encode(text))//2 h, doc_id % 3 = 0 wrong from documents"
QUERIES = {"s1_signature": s1_signature, "s3_boxes": s3_boxes, "s4_events": s4_events, "s5_codestreams": s5_codestreams}
ORACLE = {
    "s1_signature": ("contents", SIGNATURE_SQL),
    "s3_boxes": (None, "select doc_id, 'JXL ' box, 8::bigint as offset, 4::bigint length from documents union all select doc_id, 'jxlc', case when doc_id % 3 = 1 then 28 else 20 end, octet_length(encode(text)) from documents"),
    "s4_events": (None, f"""with t as ({_T}) select doc_id, 0 seq, 'kind' event, 'container' as name, 0::bigint as offset, (12+12+h+13+12+n-h)::bigint length from t union all select doc_id, 1, 'aux', 'JXL ', 8, 4 from t
union all select doc_id, 2, 'codestream', 'jxlp', 24, h from t union all select doc_id, 3, 'aux', 'Exif', 32+h, 5 from t union all select doc_id, 4, case when wrong then 'invalid' else 'codestream' end, 'jxlp', case when wrong then 45+h else 49+h end, case when wrong then n-h+4 else n-h end from t"""),
    # the first half of a text's bytes by its hexadecimal form
    "s5_codestreams": (None, f"with t as (select *, hex(encode(text)) x from ({_T}) join documents using (doc_id)) select doc_id, (case when wrong then h else n end)::int n, md5(case when wrong then unhex(substr(x, 1, 2*h)) else encode(text) end) digest from t"),
}
