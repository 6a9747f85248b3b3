"""Decoding as bytes arrive: chunks keyed by file in, stages out; and sections held until what they need is there.

The state of a file is its bytes so far and its stage; of a frame, the sections that wait. It goes when the file's headers are read or the
frame is whole. Both run in any order of chunks within the order that their numbers give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.bitstream import headers
from tessera.bitstream.bits import Bits, StreamError
from tessera.streaming.sections import drain

STAGES = ("initialised", "image_info", "frame_info")


def read_stage(raw: bytes) -> tuple[str, int]:
    """How far the bytes go, and a hint how many more the next header asks for, as far as it can be read with zeros in place of them."""
    stage, b = STAGES[0], Bits(raw)
    try:
        b.skip(16)
        b.check()
        file = headers.read_file_header(b)
        stage = STAGES[1]
        frame = headers.read_frame_header(b, file)
        headers.read_contents(b, frame["sections"])
        return STAGES[2], 0
    except (EOFError, StreamError, IndexError):
        if not b.missing:  # what was read as zeros beyond the end breaks rules, too
            raise
        return stage, b.missing


def resumable(chunks: DataFrame) -> DataFrame:
    """A stream of (id, seq, chunk) to (id, seq, stage, missing): the stage after each chunk, until the frame's header is read."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raw, upto, held = state.get if state.exists else (b"", 0, "")
        waiting = {int(k): bytes.fromhex(v) for k, v in (x.split(":") for x in held.split())}
        for pdf in parts:
            waiting.update(zip(pdf["seq"].tolist(), map(bytes, pdf["chunk"])))
        out = []
        while upto >= 0 and upto in waiting:
            raw += waiting.pop(upto)
            stage, missing = read_stage(raw)
            out.append((key[0], upto, stage, missing))
            upto = upto + 1 if stage != STAGES[2] else -1
        # a file whose headers are read keeps no bytes; what still comes is for the sections
        state.update((raw if upto >= 0 else b"", upto, " ".join(f"{k}:{v.hex()}" for k, v in waiting.items()) if upto >= 0 else ""))
        yield pd.DataFrame(out, columns=["id", "seq", "stage", "missing"])

    return chunks.groupBy("id").applyInPandasWithState(run, "id long, seq int, stage string, missing int", "raw binary, upto int, held string", "append", GroupStateTimeout.NoTimeout)


SECTIONS, LF = 50, 4  # of a frame, and of them low-frequency ones; the rest are 11 groups in passes


def needs(section: int) -> list[int]:
    """The sections that must be done before one."""
    if section == 0:
        return []
    if section <= LF:
        return [0]
    if section == LF + 1:
        return list(range(1, LF + 1))
    return [LF + 1] if section <= LF + 12 else [section - 11]


def held_sections(arriving: DataFrame) -> DataFrame:
    """A stream of (frame, section, arrival) to (frame, section, arrival, released): released is the arrival that let a section go."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, waiting = (set(state.get[0]), dict(zip(state.get[1], state.get[2]))) if state.exists else (set(), {})
        new = pd.concat(list(parts)).sort_values("arrival")
        out = []
        for section, arrival in zip(new["section"].tolist(), new["arrival"].tolist()):
            waiting[section] = arrival
            ready = True
            while ready:
                ready = sorted(s for s in waiting if all(n in done for n in needs(s)))
                for s in ready:
                    out.append((key[0], s, waiting.pop(s), arrival))
                    done.add(s)
        if len(done) == SECTIONS:
            state.remove()
        else:
            state.update((sorted(done), list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["frame", "section", "arrival", "released"])

    return arriving.groupBy("frame").applyInPandasWithState(run, "frame long, section int, arrival int, released int", "done array<int>, waiting array<int>, arrivals array<int>", "append", GroupStateTimeout.NoTimeout)


def t1_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's file in chunks of three bytes."""
    from tessera.operators.streams import _written

    customers = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/customer.parquet").schema).option("pathGlobFilter", "customer.parquet*").parquet(sf_dir)
    files = _written(customers)
    chunks = files.select("id", F.explode(F.expr("sequence(0, cast((length(bytes)-1) div 3 as int))")).alias("seq"), "bytes").select("id", "seq", F.expr("substring(bytes, seq*3+1, 3)").alias("chunk"))
    return drain(resumable(chunks), "append")


def t3_held_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty events are a frame's sections, which arrive in an order of their own."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return drain(held_sections(events.select(F.expr(f"event_id div {SECTIONS}").alias("frame"), (F.col("event_id") % SECTIONS).cast("int").alias("section"), (F.col("event_id") * 19 % SECTIONS).cast("int").alias("arrival"))), "append")


QUERIES = {"t1_resumable": t1_resumable, "t3_held_sections": t3_held_sections}
ORACLE_SQL = {
    "t3_held_sections": f"""with a as (select event_id//{SECTIONS} frame, (event_id % {SECTIONS})::int section, (event_id*19 % {SECTIONS})::int arrival from events), n as (select frame from a group by 1 having count(*) = {SECTIONS}),
b as (select a.* from a join n using (frame)), g as (select frame, max(arrival) filter (section = 0) r0, max(arrival) filter (section between 1 and {LF}) lf, max(arrival) filter (section = {LF + 1}) hf from b group by 1),
c as (select b.*, r0, greatest(r0, lf) r1, greatest(r0, lf, hf) r2, max(case when section > {LF + 1} then arrival end) over (partition by b.frame, case when section > {LF + 1} then (section-{LF + 2}) % 11 else -section-1 end order by section) r3 from b join g on g.frame = b.frame)
select frame, section, arrival, (case when section = 0 then r0 when section <= {LF} then greatest(r0, arrival) when section = {LF + 1} then r2 else greatest(r2, r3) end)::int released from c""",
}
