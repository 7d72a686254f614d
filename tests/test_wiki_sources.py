"""Wiki folders: the data source, what it refuses and skips, and which folders are wikis' roots."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.sources import folder, wiki


def tree(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_every_file_once_and_no_links(spark, tmp_path, parts):
    root, outside = tmp_path / "w", tmp_path / "outside"
    tree(outside, {"secret.md": "secret"})
    names = {f"{a}/{b}/{k}.md": f"{a}{b}{k}" for a in "xyz" for b in ("p q", "r") for k in range(3)} | {"top.md": "top", "x/own.TXT": "own", "bad.md": b"a\xffb", "deep/1/2/3/4/é.md": "deep", "empty.md": ""}
    tree(root, names)
    os.symlink(outside / "secret.md", root / "link.md")
    os.symlink(outside, root / "linked")
    os.symlink(root / "x", root / "z" / "inside")
    got = {r["path"]: r for r in folder.files(spark, str(root), parts=parts).collect()}
    assert set(got) == set(names) and got["bad.md"]["raw"] == "a�b" and got["empty.md"]["raw"] == ""
    r = got["x/p q/1.md"]
    assert (r["folder"], r["name"], r["extension"], r["size"], r["raw"]) == ("x/p q", "1.md", ".md", 4 + 1, "xp q1"[:5])
    assert got["x/own.TXT"]["extension"] == ".txt" and r["modified"] is not None
    assert folder.files(spark, str(root), contents=False, parts=parts).where("raw is not null").count() == 0
    with pytest.raises(Exception, match="no such wiki folder"):
        folder.files(spark, str(tmp_path / "none")).count()


def test_conditions_reach_the_listing(spark, tmp_path):
    tree(tmp_path, {f"{a}/{b}/{k}.md": "t" for a in "xyz" for b in "pq" for k in range(3)} | {"x/p/n.txt": "t"})
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    def listed(*filters):
        reader = folder.PushingReader(str(tmp_path), 2, True)
        opened = []
        real = reader._entries
        reader._entries = lambda f: opened.append(f) or real(f)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sorted(r[0] for p in reader.partitions() for r in reader.read(p)), set(opened)

    got, opened = listed(StringStartsWith(("path",), "x/p/"))
    assert got == ["x/p/0.md", "x/p/1.md", "x/p/2.md", "x/p/n.txt"] and opened == {"", "x", "x/p"}
    got, opened = listed(EqualTo(("path",), "y/q/1.md"))
    assert got == ["y/q/1.md"] and opened == {"", "y", "y/q"}
    got, opened = listed(In(("folder",), ("x/p", "z/q")), EqualTo(("extension",), ".txt"))
    assert got == ["x/p/n.txt"] and opened == {"", "x", "z", "x/p", "z/q"}
    found = folder.files(spark, str(tmp_path), parts=2, pushdown=True).where(F.col("path").startswith("x/p/") & (F.col("extension") == ".md")).select("path")
    assert sorted(r["path"] for r in found.collect()) == ["x/p/0.md", "x/p/1.md", "x/p/2.md"] and found.rdd.getNumPartitions() < folder.files(spark, str(tmp_path), parts=2).rdd.getNumPartitions()
    few = folder.files(spark, str(tmp_path), below=["x/p", "z"], extensions=[".md"])
    assert sorted(r["path"] for r in few.collect()) == [f"x/p/{k}.md" for k in range(3)] + [f"z/{b}/{k}.md" for b in "pq" for k in range(3)]
    assert few.union(few.where("extension = '.txt'")).count() == 9


def test_signals_of_any_folder(spark, tmp_path):
    tree(tmp_path, {
        "a/index.md": "", "a/Overview.MD": "", "b/concepts/x/y.md": "", "c/.wiki-compiler.json": "{}", "d/n.md": "", "d/e/sources/queries/z.md": "", "f/node_modules/index.md": "", "g/.vscode/index.md": "",
        "concepts/readme.txt": "", "h/concepts.md": "",
    })
    got = {r["folder"]: (r["marker"], r["hubs"], r["typed"]) for r in wiki.signals(wiki.included(folder.files(spark, str(tmp_path)))).collect()}
    assert got == {"a": (False, ["index.md", "overview.md"], False), "b": (False, [], True), "c": (True, [], False), "d/e": (False, [], True), "d/e/sources": (False, [], True)}


CASES = [
    # files, adapter, folder with the pages, hub roots
    ({"wiki/index.md": "", "readme.md": ""}, "native", "wiki", ()),
    ({"openwiki/quickstart.md": ""}, "native", "openwiki", ()),
    ({"wiki/plain.md": "", "readme.md": ""}, "markdown", "", ()),
    ({"wiki/concepts/a.md": ""}, "native", "wiki", ()),
    ({"wiki/.wiki-compiler.json": "{}", "wiki/x.md": ""}, "native", "wiki", ()),
    ({"hot.md": "", "index.md": ""}, "native", "", ()),
    ({"index.md": "", "entities/a.md": ""}, "native", "", ()),
    ({"index.md": "", "a.md": ""}, "markdown", "", ()),
    ({".wiki-compiler.json": "{}", "a.md": ""}, "native", "", ()),
    ({"a.md": "", "team/index.md": "", "team/hot.md": "", "solo/index.md": "", "lib/projects/p.md": "", "build/index.md": "", "build/hot.md": "", "WIKI/quickstart.md": ""}, "markdown", "", ("WIKI", "lib", "team")),
    ({".obsidian/app.json": "", "a.md": "", "team/concepts/x.md": "", "wiki/index.md": ""}, "obsidian", "", ("wiki", "team")),
    ({"quartz.config.ts": "", "content/a.md": "", "content/sub/index.md": "", "content/sub/hot.md": ""}, "quartz", "content", ("sub",)),
]


@pytest.mark.parametrize("case", CASES)
def test_roots(spark, tmp_path, case):
    files, adapter, below, hubs = case
    root = tmp_path / "notes"
    tree(root, files)
    how = wiki.layout(str(root), spark)
    assert (how.adapter, os.path.relpath(how.path_root, root).replace(".", "", 1) if how.path_root == str(root) else os.path.relpath(how.path_root, root), how.hub_roots) == (adapter, below, hubs)


def test_hub_names_count_in_nested_roots(spark, tmp_path):
    root = tmp_path / "notes"
    tree(root, {"a.md": "# A", "team/index.md": "---\nwiki_title: The Team\ndescription: All of it\n---\n# Team", "team/hot.md": "x", "team/sub/hot.md": "x", "solo/index.md": "x"})
    got = {r["path"]: r["role"] for r in wiki.pages(spark, str(root)).collect()}
    assert got == {"a.md": "topic", "team/index.md": "index", "team/hot.md": "hot", "team/sub/hot.md": "topic", "solo/index.md": "topic"}
    assert wiki.described(spark, str(root)) == ("The Team", "All of it")
    empty = tmp_path / "empty"
    tree(empty, {"a.txt": ""})
    assert wiki.described(spark, str(empty)) == ("empty", "")
    with pytest.raises(FileNotFoundError, match="no supported"):
        wiki.checked(spark, str(empty))


def test_logseq_names_and_org_files(spark, tmp_path):
    tree(tmp_path, {"logseq/config.edn": "{}", "pages/a___b.md": "text", "journals/2024_01_01.org": "* Head", "pages/.vscode/x.md": "no", "other/z.md": "no", "logseq/bak.md": "no"})
    got = {r["path"]: r["title"] for r in wiki.pages(spark, str(tmp_path)).collect()}
    assert got == {"pages/a___b.md": "a/b", "journals/2024_01_01.org": "2024_01_01"}
