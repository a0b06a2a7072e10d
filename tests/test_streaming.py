import datetime as dt

from weftline.streaming import audit


def test_documents_are_logged_once(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    body = "Este es un texto de la base que se usa para los datos"
    rows = [(1, "Uno", body, ts), (2, None, body, ts), (3, "Tres", body.upper(), ts)]
    spark.createDataFrame(rows, "doc_id bigint, title string, body string, ts timestamp").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        audit.log_to(audit.analysed(audit.documents_in(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert {r["doc_id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "ok", 2: "campo_faltante", 3: "ok"}
    q = audit.without_repeats(audit.documents_in(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("distinct_docs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("distinct_docs").count() == 1
