import pyarrow as pa

from tenura.llm import common


def test_a_worker_keeps_what_its_stage_remembers_and_lets_go_of_the_rest(spark):
    built = []
    assert common.remembered("a", (1,), lambda: built.append(1) or "x") == "x"
    assert common.remembered("a", (1,), lambda: built.append(2) or "y") == "x" and built == [1]
    assert common.remembered("a", (2,), lambda: "z") == "z"
    assert common.remembered("b", (1,), lambda: "w") == "w" and list(common._remembered) == ["b"]
    common.let_go("a")
    assert common._remembered == {}

    def keeping(batches):
        for batch in batches:
            common.remembered("other", (), lambda: "kept")
            yield pa.RecordBatch.from_arrays([pa.array([0] * batch.num_rows)], ["n"])

    def counting(batches):
        held = len(common._remembered)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held] * batch.num_rows)], ["n"])

    df = spark.range(4).coalesce(1)
    assert {r.n for r in common.map_batches(df, keeping, "n bigint").collect()} == {0}
    assert {r.n for r in common.map_batches(df, counting, "n bigint").collect()} == {0}
