"""The data source of archives: one archive in many tasks, conditions answered by the directory, odd members."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.sources import files, zips


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(60):
            z.writestr(f"src/f{i}.{'py' if i % 3 else 'md'}", hashlib.sha256(str(i).encode()).digest() * 40)
        z.writestr("folder/", b"")
    with zipfile.ZipFile(tmp_path / "in" / "odd.ZIP", "w") as z:
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc")
        for name in ("ok.txt", "../out.txt", "/abs.txt", "empty"):
            z.writestr(name, "" if name == "empty" else name)
    (tmp_path / "in" / "broken.zip").write_bytes(b"no archive")
    spark.dataSource.register(zips.ZipMembers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield str(tmp_path / "in")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def load(spark, folder, **options):
    return spark.read.format("zip_members").options(path=folder, **{k: str(v).lower() for k, v in options.items()}).load()


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_many_tasks_one_result(spark, folder, prefix):
    one, many = load(spark, prefix + folder), load(spark, prefix + folder, rangeBytes=150)
    rows = lambda df: sorted(((x.archive.rpartition("/")[2], x.path, x.size, x.sha256, x.content and bytes(x.content), x.problem) for x in df.collect()), key=repr)
    assert rows(one) == rows(many) and one.rdd.getNumPartitions() == 3 and many.rdd.getNumPartitions() > 20
    got = rows(one)
    assert len(got) == 60 + 5 + 1 and all(s == hashlib.sha256(c).hexdigest() for _, _, _, s, c, p in got if p is None)
    assert {(a, n): p for a, n, _, _, _, p in got if p} == {("odd.ZIP", "link"): "link", ("odd.ZIP", "../out.txt"): "unsafe", ("odd.ZIP", "/abs.txt"): "unsafe", ("broken.zip", None): "broken"}
    old = files.archives(spark, folder).where("archive like '%big.zip'").select("path", "size", "sha256")
    assert {tuple(x) for x in old.collect()} == {tuple(x) for x in one.where("archive like '%big.zip'").select("path", "size", "sha256").collect()}


def test_conditions_choose_members(spark, folder):
    every = load(spark, folder, rangeBytes=150, pushdown=True)
    some = every.where("path like 'src/%' and path like '%.md'").select("path", F.length("content").alias("n"))
    assert {x.path for x in some.collect()} == {f"src/f{i}.md" for i in range(0, 60, 3)} and some.rdd.getNumPartitions() < 25
    assert every.where("size > 100000").count() == 0 and every.where("problem is not null").count() == 4 and every.where("problem is null and size = 0").count() == 1
    assert every.where("path in ('ok.txt', 'empty') and size >= 1").select("path").collect()[0].path == "ok.txt"
    assert every.where("archive like '%odd%' and length(content) = 6").count() == 1  # Spark's own condition on top
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    plain = load(spark, folder, rangeBytes=150).where("path like 'src/%' and path like '%.md'")
    assert plain.count() == 20 and plain.rdd.getNumPartitions() > some.rdd.getNumPartitions()


def test_limits_and_empty_folders(spark, folder, tmp_path):
    got = load(spark, folder, mostBytes=3000).where("archive like '%big.zip'")
    assert got.where("problem = 'too large'").count() == 58 and got.where("problem is null").count() == 2
    (tmp_path / "none").mkdir()
    assert load(spark, str(tmp_path / "none")).count() == 0


def test_archives_without_members(spark, tmp_path):
    """A task without rows writes an archive without members, which is not broken."""
    pages = spark.range(3).selectExpr("concat('p', id) as path", "'x' as body").repartition(8, F.lit(1))
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    zips.write(pages, "path", "body", str(tmp_path))
    spark.dataSource.register(zips.ZipMembers)
    got = spark.read.format("zip_members").option("path", str(tmp_path)).load().select("path", "problem").collect()
    assert sorted(tuple(x) for x in got) == [("p0", None), ("p1", None), ("p2", None)]
