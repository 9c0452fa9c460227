from pyspark.sql import functions as F

from marginalia.plans.ingest import ingest
from marginalia.session import shared_dir
from marginalia.sources import tables
from marginalia.streaming import ingest as si


def parsed(spark, *texts, start=0):
    from marginalia.sources import formats as fm

    rows = spark.createDataFrame([(f"doc_{n}", n, t) for n, t in enumerate(texts, start)], "document_id string, doc_seq bigint, t string")
    return rows.select(
        "document_id", F.concat("document_id", F.lit(".txt")).alias("document_name"), "doc_seq",
        F.concat(F.lit("job_"), "document_id").alias("job_id"), F.lit("txt").alias("suffix"), F.lit(1).alias("probed_pages"),
        fm.parse_plain_text(F.col("t")).alias("parsed"),
    )


LONG = "Falcon records must stay on the local machine for {} months."


def snippets(spark, root):
    return sorted((r.document_id, r.snippet) for r in si.current_evidence(spark, root).collect())


def test_file_stream_picks_up_new_files_once(spark, tmp_path):
    uploads, root = tmp_path / "uploads", str(tmp_path / "root")
    uploads.mkdir()
    (uploads / "a.txt").write_text(LONG.format(1))
    (uploads / "skip.exe").write_text("x" * 100)

    def run():
        files = si.parsed_uploads(si.file_stream(spark, str(uploads)))
        si.start_ingest(files, root, f"{root}/checkpoint", once=True).awaitTermination()

    run()
    assert [s for _, s in snippets(spark, root)] == [LONG.format(1)]
    (uploads / "b.md").write_text(LONG.format(2))
    (uploads / "empty.txt").write_text("....")
    run()
    run()  # nothing new
    assert sorted(s for _, s in snippets(spark, root)) == [LONG.format(n) for n in (1, 2)]
    (rejected,) = si.rejected_files(spark, root).collect()
    assert (rejected.document_name, rejected.size_bytes, rejected.reason_code) == ("skip.exe", 100, "unsupported_file_type")
    jobs = tables.read_batches(spark, root, "jobs", si.JOB_COLUMNS)
    assert sorted(r.status for r in jobs.collect()) == ["failed", "ready", "ready"]
    documents = tables.read_batches(spark, root, "documents", si.DOCUMENT_COLUMNS)
    assert sorted(r.status for r in documents.collect()) == ["ready", "ready", "review"]


def test_reingest_replaces_and_retries_are_harmless(spark, tmp_path):
    root = str(tmp_path / "root")
    write = si.store_batch(root)
    write(parsed(spark, LONG.format(1), LONG.format(2)), 0)
    write(parsed(spark, LONG.format(3)), 1)
    write(parsed(spark, LONG.format(3)), 1)  # the same batch again
    want = [("doc_0", LONG.format(3)), ("doc_1", LONG.format(2))]
    assert snippets(spark, root) == want
    # A batch cut short before its document rows stays invisible.
    tables.write_batch(ingest(parsed(spark, LONG.format(9))).evidence, root, "evidence", 2)
    assert snippets(spark, root) == want
    # A document that loses its text loses its evidence.
    write(parsed(spark, "...."), 3)
    assert snippets(spark, root) == want[1:]


def test_vectors_follow_the_newest_evidence(spark, tmp_path):
    root = str(tmp_path / "root")
    write = si.store_batch(root, embedder=lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    write(parsed(spark, LONG.format(1), LONG.format(2)), 0)
    write(parsed(spark, LONG.format(300)), 1)
    evidence = sorted((r.id, r.snippet) for r in si.current_evidence(spark, root).collect())
    vectors = sorted((r.id, r.snippet) for r in si.current_vectors(spark, root).collect())
    assert vectors == evidence and [s for _, s in vectors] == [LONG.format(300), LONG.format(2)]
    assert {r.embedding[0] for r in si.current_vectors(spark, root).collect()} == {float(len(s)) for _, s in evidence}
    write(parsed(spark, "...."), 2)
    assert [r.document_id for r in si.current_vectors(spark, root).collect()] == ["doc_1"]


class Session:
    """Just what ``shared_dir`` asks of a session."""

    def __init__(self, named):
        self.conf, self.sparkContext, self.made = {"spark.checkpoint.dir": named}, self, None

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


def test_shared_folder_comes_from_the_session():
    cluster = Session("/shared/checkpoints/")
    assert shared_dir(cluster) == "/shared/checkpoints" and cluster.made is None
    alone = Session(None)
    assert shared_dir(alone) == shared_dir(alone) == alone.made


def test_corpus_stream_reads_one_file_or_a_folder_of_files(spark, tmp_path):
    from marginalia.plans.catalog import QUERIES

    rows = spark.createDataFrame([(n, LONG.format(n), "src") for n in range(6)], "doc_id bigint, text string, source string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    (file,) = (tmp_path / "part").glob("part-*.parquet")
    (tmp_path / "one" / "documents.parquet").write_bytes(file.read_bytes())
    for folder in ("one", "many"):
        got = QUERIES["incremental_ingest"](spark, str(tmp_path / folder)).collect()
        assert sorted(r.document_id for r in got) == [f"doc_{n}" for n in range(6)]
