import io
import json
import os
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from residuum import cli
from residuum.operators import manifest
from residuum.sources import archives, manifests, trees
from residuum.streaming import manifests as streaming


def put(root, **files):
    for name, body in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


@pytest.fixture
def plugin(tmp_path):
    root = tmp_path / "acme"
    root.mkdir()
    (root / "acme.php").write_text("<?php\n/*\n * Plugin Name: Acme Tools\n * Version: 1.2\n */\nadd_option('acme_a');\nset_transient('acme_t', 1);\n")
    (root / "uninstall.php").write_text("<?php delete_option('acme_a');")
    for rel in ("vendor/x.php", "Tests/y.php", "inc/z.PHP", "build/a.php", "build/b/render.php", "readme.txt"):
        (root / rel).parent.mkdir(exist_ok=True)
        (root / rel).write_text("<?php add_option('not_" + rel[0] + "');" if rel[0] in "vTr" else "<?php echo 1;")
    os.symlink(root / "acme.php", root / "link.php")
    return root


def test_walk_and_files(spark, plugin):
    kept = ["acme.php", "build/b/render.php", "inc/z.PHP", "uninstall.php"]
    assert trees.walk(str(plugin)) == kept
    assert trees.walk(str(plugin / "acme.php")) == ["acme.php"] and trees.walk("/nowhere") == []
    local = trees.local_files(spark, {"acme": str(plugin)})
    assert sorted(r["rel"] for r in local.collect()) == kept
    head = trees.headers(local).first()
    assert (head["plugin_name"], head["plugin_version"]) == ("Acme Tools", "1.2")
    os.unlink(plugin / "link.php")
    listed = trees.plugin_files(spark, str(plugin.parent))
    assert sorted((r["slug"], r["rel"]) for r in listed.collect()) == [("acme", k) for k in kept]


def test_guards(spark):
    rows = [("s", "big.php", 9_000_000, None), ("s", "gone.php", -1, None), ("s", "ok.php", 3, bytearray(b"abc"))]
    found = {r["file"]: r["code"] for r in trees.guard_errors(spark.createDataFrame(rows, trees.FILES)).collect()}
    assert found == {"big.php": "E_SIZE", "gone.php": "E_IO"}


def test_commands(spark, plugin, tmp_path, capsys):
    run = lambda *argv: (cli.main(list(argv), spark), capsys.readouterr().out)
    code, out = run("scan", str(plugin), "--json")
    doc = json.loads(out)
    assert code == 0 and doc["grade"] == "C" and doc["plugin"] == {"slug": "acme", "name": "Acme Tools", "version": "1.2"} and doc["coverage"]["files_scanned"] == 4
    assert [i["key"] for i in doc["creates"]["options"]] == ["acme_a"]
    assert run("scan", str(plugin))[0] == 0 and run("scan", "/nowhere")[0] == 1 and run("check", "/nowhere")[0] == 2
    assert run("grade", str(plugin))[1].startswith("C ")
    assert run("check", str(plugin))[0] == 0 and run("check", str(plugin), "--fail-on", "C")[0] == 1 and run("check", str(plugin), "--fail-on", "Z")[0] == 2
    code, out = run("uninstall", str(plugin))
    assert code == 0 and "delete_transient('acme_t');" in out and "delete_option" not in out
    base = tmp_path / "base.json"
    base.write_text(json.dumps(doc))
    assert run("diff", str(base), str(plugin))[0] == 0
    (plugin / "new.php").write_text("<?php add_option('acme_new');")
    code, out = run("diff", str(base), str(plugin))
    assert code == 1 and "added: options:acme_new" in out and run("diff", "/nowhere", str(plugin))[0] == 2
    with pytest.raises(SystemExit) as usage:
        cli.main(["nonsense"])
    assert usage.value.code == 2


def test_batch_and_index(spark, plugin, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["batch", str(plugin.parent), "--out", str(out), "--report", str(tmp_path / "report.json")], spark) == 0
    assert {p.name for p in out.glob("*.json")} == {"acme.json"}
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["scanned"] == 1 and not report["failed"]
    assert cli.main(["batch", str(plugin.parent), "--out", str(out), "--resume"], spark) == 0
    (out / "broken.json").write_text("{")
    (out / "old.json").write_text(json.dumps({"schema_version": "1.0", "grade": "A", "coverage": {"files_scanned": 0}, "creates": {"options": [{"key": "blogname"}], "odd": []}, "plugin": {"slug": "old"}}))
    (out / ".hidden.json").write_text("{}")
    capsys.readouterr()
    assert cli.main(["index", str(out)], spark) == 1
    said = capsys.readouterr().out
    assert "3 manifests" in said and all(k in said for k in ("unreadable: 1", "schema_version: 1", "zero_files: 1", "core_artifacts: 1"))
    stats = json.loads((out / "stats.json").read_text())
    assert stats["plugins"] == 3 and stats["artifacts"]["artifacts"] == 3
    assert cli.main(["index", "/nowhere"], spark) == 1


def test_manifest_json(spark):
    doc = {"grade": "A", "coverage": {"resolution_rate": 1.0}, "creates": {"options": []}}
    rows = spark.createDataFrame([(json.dumps(doc),), ("[]",), ('{"grade":"A"}',), ("\ufffd{",)], "j string")
    out = [r["t"] for r in rows.select(manifest.to_json(manifest.from_json(F.col("j"))).alias("t")).collect()]
    assert '"resolution_rate":1.0' in out[0] and '"files_skipped":null' in out[0] and out[1:] == [None, None, None]


def test_folders_with_brackets(spark, tmp_path):
    folder = tmp_path / "a[1]{x}"
    folder.mkdir()
    (folder / "s p+ace.json").write_text(json.dumps({"grade": "A", "coverage": {}, "creates": {}}))
    row = manifests.read_manifests(spark, str(folder)).first()
    assert (row["file"], row["slug"]) == ("s p+ace.json", "s p+ace") and row["doc"] is not None


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            if body is None:
                info = zipfile.ZipInfo(name)
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
                z.writestr(info, "/etc/passwd")
            else:
                z.writestr(name, body)
    return out.getvalue()


@pytest.mark.parametrize("name", ["../x.php", "/abs.php", "C:/x.php", "a/../../x.php", "a\\..\\..\\x.php"])
def test_unsafe_archives(tmp_path, name):
    with pytest.raises(archives.FetchError):
        archives.unpack(archive({name: "x"}), tmp_path / "t")


def test_archives(tmp_path, monkeypatch):
    with pytest.raises(archives.FetchError):
        archives.unpack(archive({"link": None}), tmp_path / "t")
    with pytest.raises(archives.FetchError):
        archives.unpack(b"no zip", tmp_path / "t")
    monkeypatch.setattr(archives, "SIZE_CEILING", 10)
    with pytest.raises(archives.FetchError):
        archives.unpack(archive({"big": "x" * 100}), tmp_path / "t")


def test_fetch(tmp_path):
    urls = {"info": "https://x/{slug}.info", "versioned": "https://x/{slug}.{version}.zip", "unversioned": "https://x/{slug}.zip"}
    body = archive({"acme/acme.php": "<?php\n/*\rPlugin Name: Acme\rVersion: 2.0 */\n"})
    asked = []

    def get(pages):
        def one(url):
            asked.append(url)
            if url not in pages:
                raise archives.FetchError("404")
            return pages[url]
        return one

    info = {"https://x/acme.info": b'{"version": "2.0"}'}
    place = archives.fetch(urls, "acme", None, tmp_path, get(info | {"https://x/acme.zip": body}))
    assert (place / "acme.php").is_file() and (tmp_path / "acme-2.0.sha256").is_file()
    asked.clear()
    assert archives.fetch(urls, "acme", "2.0", tmp_path, get({})) == place and not asked
    with pytest.raises(archives.FetchError):
        archives.fetch(urls, "acme", "1.0", tmp_path, get(info | {"https://x/acme.zip": body}))
    for bad in ("../x", "A", ""):
        with pytest.raises(archives.FetchError):
            archives.fetch(urls, bad, "1.0", tmp_path, get({}))
    with pytest.raises(archives.FetchError):
        archives.https_get("http://x/")


def test_writes_are_whole(tmp_path):
    path = tmp_path / "a" / "b.json"
    manifests.write_text(str(path), "one")
    manifests.write_text(str(path), "two")
    assert path.read_text() == "two" and os.listdir(path.parent) == ["b.json"]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.json").write_text(json.dumps({"grade": "A", "coverage": {}, "creates": {"options": [{"key": "k", "cleaned": True}]}, "plugin": {"slug": "s", "version": "1"}}))
    query = streaming.keep_lookup(streaming.stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [(r["slug"], r["type"], r["key"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("s", "option", "k")]


def test_shards_and_the_floor(spark, tmp_path, monkeypatch, capsys):
    body = lambda slug: archive({f"{slug}.php": f"<?php\n/* Plugin Name: {slug}\nVersion: 1.0 */ update_option('{slug}_o', 1);"})

    def get(url):
        slug = url.rpartition("/")[2].split(".")[0]
        if slug == "gone":
            raise archives.FetchError("404")
        return body(slug)

    monkeypatch.setattr(archives.fetch, "__defaults__", (get,))
    pinned = tmp_path / "pinned.json"
    pinned.write_text(json.dumps({"acme": "1.0", "gone": "1.0", "bolt": "1.0"}))
    run = tmp_path / "run"
    for shard in ("0", "1"):
        assert cli.main(["shard", str(pinned), str(run), "--shard", shard, "--shards", "2", "--cache", str(tmp_path / "cache")], spark) == 0
    assert sorted(p.name for p in (run / "manifests").glob("*.json")) == ["acme.json", "bolt.json"]
    # One of three may be missing.
    assert cli.main(["assemble", str(pinned), str(run)], spark) == 0
    out = capsys.readouterr().out
    assert "2 of 3 pinned plugins have a manifest; 1 missing, 1 not fetched, 0 not on the list" in out and "missing: gone" in out
    (run / "manifests" / "bolt.json").rename(run / "manifests" / "old.json")
    assert cli.main(["assemble", str(pinned), str(run)], spark) == 1
    out = capsys.readouterr()
    assert "missing: bolt, gone" in out.out and "not on the list: old" in out.out and "more than the 1" in out.err
    (run / "manifests" / "old.json").rename(run / "manifests" / "bolt.json")
    assert sorted(json.loads((run / "provenance.json").read_text())) == ["acme", "bolt"]
    assert json.loads((run / "fetch-failures.json").read_text())["gone"]["version"] == "1.0"
    assert cli.main(["assemble", str(tmp_path / "none.json"), str(run)], spark) == 1
    assert cli.main(["shard", str(pinned), str(run), "--shard", "2", "--shards", "2"], spark) == 2
    assert cli.main(["index", str(run / "manifests"), "--out", str(tmp_path / "index")], spark) == 0
    assert json.loads((tmp_path / "index" / "reverse-lookup.json").read_text()) == {"option:acme_o": ["acme"], "option:bolt_o": ["bolt"]}


def test_slow_plugins_fail_alone(spark, tmp_path):
    for slug, body in (("slow", "<?php " + "if ($a) {" * 3000 + "}" * 3000 + "elseif ($b) {} " * 20000), ("good", "<?php update_option('a', 1);")):
        (tmp_path / slug).mkdir()
        (tmp_path / slug / "a.php").write_text(body)
    (tmp_path / "empty").mkdir()
    report = tmp_path / "report.json"
    assert cli.main(["batch", str(tmp_path), "--out", str(tmp_path / "out"), "--timeout", "0.5", "--report", str(report)], spark) == 1
    told = json.loads(report.read_text())
    assert told["scanned"] == 1 and sorted(told["failed"]) == ["empty", "slow"] and "0.5 seconds" in told["failed"]["slow"]
    assert os.path.exists(tmp_path / "out" / "good.json") and not os.path.exists(tmp_path / "out" / "slow.json")
