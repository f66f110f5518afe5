import random

from lonepoint.params import Params
from lonepoint.streaming import replay, structured


def test_stream_gives_what_replay_gives(spark, tmp_path):
    rng = random.Random(2)
    p = Params(20, 5, 0.6, 2)
    rows = [(s, i, [round(rng.gauss(0, 2), 1)]) for s, n in (("a", 83), ("b", 41)) for i in range(1, n + 1)]
    schema = "stream_id string, id long, values array<double>"
    for k in range(4):  # micro-batches cut slides anywhere
        part = [r for r in rows if k * 23 < r[1] <= (k + 1) * 23] + ([("a", 84, None), ("b", 42, None)] if k == 3 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, detector in (("exact", replay.Exact(p)), ("clusters", replay.MicroClusters(p, 6, 0.1, 3))):
        q = structured.detect(stream, detector).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((r.stream_id, r.kind, r.id, r.residents, r.outliers) for r in spark.sql(f"SELECT * FROM {name}").collect())
        want = sorted((r.stream_id, r.kind, r.id, r.residents, r.outliers) for r in replay.replay(spark.createDataFrame(rows, schema), detector).collect())
        assert got == want and len(got) > 30
