import os

from corvane.operators import scope
from corvane.sources import listing
from corvane.sources.content import folders


def tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def below(root, rows):
    return {name for r in rows if not (name := os.path.relpath(r.path, root)).endswith(".gitignore")}


def test_excluded_folders_stay_unopened(spark, tmp_path):
    tree(tmp_path, {
        "a.md": "a", "sub/b.md": "b", "sub/deep/er/c.py": "x = 1", "node_modules/x/y.md": "no", ".hidden/z.md": "no", "made/out.md": "no", "made/more/out.md": "no",
        "sub/made/kept.md": "yes", "sub/tmp/t.md": "no", "sub/deep/tmp/t.md": "no", "tmp/kept.md": "yes", "sub/d.log.md": "no", "sub/keep.log.md": "yes", "empty.md": "", "id_rsa": "k",
        ".gitignore": "/made/\n*.log.md\n!keep.log.md\n# no rule\n", "sub/.gitignore": "tmp/\n!tmp/t.md\n",
    })
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    got = listing.walk(spark, [f"file://{tmp_path}/"])
    assert below(tmp_path, got.files.collect()) == {"a.md", "sub/b.md", "sub/deep/er/c.py", "sub/made/kept.md", "tmp/kept.md", "sub/keep.log.md"}
    opened = {os.path.relpath(r.path, tmp_path): r.readable for r in got.opened.collect()}
    assert opened == dict.fromkeys([".", "sub", "sub/deep", "sub/deep/er", "sub/made", "tmp"], True)


def test_roots_that_overlap_are_gone_or_given_rules(spark, tmp_path):
    tree(tmp_path, {"a/one.md": "1", "a/b/two.md": "2", "a/b/.gitignore": "", "skip/three.md": "3"})
    rules = scope.ignore_rules(spark.createDataFrame([(f"{tmp_path}/.gitignore", "skip/\n")], "path string, text string"))
    got = listing.walk(spark, [str(tmp_path), f"{tmp_path}/a/b", f"{tmp_path}/gone"], rules=rules)
    rows = got.files.collect()
    assert below(tmp_path, rows) == {"a/one.md", "a/b/two.md"} and len(rows) == len({r.path for r in rows}) and all(r.size < 2 and r.mtime is not None for r in rows)
    assert {os.path.relpath(r.path, tmp_path): r.readable for r in got.opened.collect()} == {".": True, "a": True, "a/b": True, "gone": False}
    nothing = listing.walk(spark, [])
    assert nothing.files.count() == nothing.opened.count() == 0


def test_same_files_as_a_walk_of_everything(spark, tmp_path):
    names = ["n1", "build", "n2", ".git", "venv"]
    tree(tmp_path, {f"{a}/{b}/{c}/f{i}.md": "text" for a in names for b in names for c in names for i in range(2)})
    tree(tmp_path, {"n1/.gitignore": "n2/*/f1.md\n", ".gitignore": "venv/\n"})
    every = [(os.path.join(d, f), os.path.getsize(os.path.join(d, f))) for d, _, fs in os.walk(tmp_path) for f in fs]
    texts = [(p, open(p).read()) for p, _ in every if p.endswith(".gitignore")]
    rules = scope.ignore_rules(spark.createDataFrame(texts, "path string, text string"))
    from pyspark.sql import functions as F

    flat = spark.createDataFrame(every, "path string, size long").where(scope.reject_reason(F.col("path"), F.col("size"), F.lit(str(tmp_path))).isNull())
    want = below(tmp_path, scope.ignored(flat, rules).where("NOT ignored").collect())
    got = listing.walk(spark, [str(tmp_path)])
    assert below(tmp_path, got.files.collect()) == want and len(want) > 4
    assert got.opened.count() < sum(1 for _ in os.walk(tmp_path)) / 2


def test_a_source_reads_each_kept_file_once(spark, tmp_path):
    tree(tmp_path, {"a.md": "# A", "b.txt": "plain", ".hidden/c.md": "no"})
    rows = folders([str(tmp_path)], glob="*.md").files(spark).collect()
    assert [(os.path.basename(r.path), r.text, r.size, r.error) for r in rows] == [("a.md", "# A", 3, None)] and len(rows[0].file_hash) == 64
    from corvane.sources import files

    gone = spark.createDataFrame([(f"{tmp_path}/x.md", 1, None)], "path string, size long, mtime timestamp")
    row = files.read_paths(gone).first()
    assert row.text is None and row.file_hash is None and "FileNotFound" in row.error
