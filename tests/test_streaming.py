from tierflow.plans.projection import RULES
from tierflow.streaming.watch import watch


def test_batches_report_the_last_state(spark, tmp_path):
    schema = "source string, target string, specifier string, is_type_only boolean, kind string, line int, version int"
    rows = [("src/handlers/a.ts", "src/shared/x.ts", "s", False, "static", 1, 1), ("src/handlers/a.ts", "src/services/x.ts", "s", False, "static", 1, 2), ("src/services/b.ts", "src/shared/y.ts", "s", False, "static", 1, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = []
    query = watch(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), RULES, lambda found, n: seen.extend((r.type, r.source_file) for r in found.collect()), checkpoint=str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert seen == [("flow", "src/services/b.ts")]
