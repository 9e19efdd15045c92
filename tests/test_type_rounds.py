"""Types over several files: results of methods, chains of them, and changes of some files against a whole scan."""

import random

import pytest
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.operators import type_rounds
from symdex.sources import core_types, extract, scan
from symdex.streaming import ingest

FILES = {
    "user.rb": """class User
  def name
    "x"
  end

  def self.top
    User.new
  end

  def best
    first = User.top
    first
  end

  def label = best.name
end
""",
    "a.rb": "y = User.new.name\nx = User.top\nz = x.best\n",
    "ping.rb": "class Ping\n  def go\n    p = Pong.new\n    p.back\n  end\n  def one\n    q = Ping.new\n    q.go\n  end\nend\n",
    "pong.rb": "class Pong\n  def back\n    p = Ping.new\n    p.go\n  end\nend\n",
    "b.rb": "r = Ping.new.go\ns = Team.lead\n",
    "team.rb": "class Team\n  def self.lead\n    u = User.top\n    u\n  end\nend\n",
    "guard.rb": "def run(x)\n  return x.best if x\n  x\nrescue\n  User.new\nend\n",
}


def scanned(spark, files):
    return spark.createDataFrame([(p, 1, hash(t), t) for p, t in files.items()], "path string, mtime_ms bigint, content_hash bigint, text string")


def rows(f, table):
    df = getattr(f, table)
    return sorted(map(str, df.select(*[F.to_json(c) if c in ("tokens", "prev_tokens") else c for c in df.columns]).collect()))


def types(f):
    return {(r["path"], r["name"]): (r["type_hint"], r["confidence"], r["round"]) for r in f.local_vars.join(f.paths(), "file_id").collect()}


def same(a, b):
    return [t for t in ("local_vars", "symbols", "calls", "params", "refs", "files", "mixins") if rows(a, t) != rows(b, t)]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts"))
    extract.extract(scanned(spark, FILES)).save(path)
    return Facts.load(spark, path)


def test_results_of_methods(whole):
    f = whole
    given = {(r["parent_name"], r["name"]): (r["return_type"], r["type_round"]) for r in f.symbols.where("kind IN ('def', 'classdef')").collect()}
    assert given["User", "name"] == ("String", None) and given["User", "top"] == ("User", None)
    assert given["User", "best"] == ("User", 2) and given["Team", "lead"] == ("User", 2)
    assert given["Ping", "go"] == given["Pong", "back"] == given["Ping", "one"] == given[None, "run"] == (None, None)  # ends, and is no guess
    got = types(f)
    assert got["a.rb", "y"] == ("String", 38, 1) and got["a.rb", "x"] == ("User", 55, 1)
    assert got["a.rb", "z"] == ("User", 55, 3)
    assert got["b.rb", "r"][0] is None and got["b.rb", "s"] == ("User", 55, 3)


def test_any_order_of_files_and_of_rows(spark, whole):
    turned = extract.extract(scanned(spark, dict(reversed(FILES.items()))).repartition(3))
    assert same(whole, turned) == []
    assert same(whole, type_rounds.typed(whole)) == []  # typing what is typed changes nothing


CHANGES = [
    {"user.rb": FILES["user.rb"].replace("User.new\n", "Team.new\n").replace('"x"', "7"), "b.rb": ""},  # another result, two files on
    {"team.rb": None, "a.rb": "x = Team.lead\nq = x.label\n"},
    {"user.rb": None, "pong.rb": "class Pong\n  def back\n    1\n  end\nend\n", "new.rb": "class Team\n  def self.lead; 1.5; end\nend\n"},
]


@pytest.mark.parametrize("change", range(len(CHANGES)))
def test_changed_files_as_a_whole_scan(spark, whole, change):
    change = CHANGES[change]
    after = {p: t for p, t in (FILES | change).items() if t is not None}
    read = lambda paths: scanned(spark, after).join(paths, "path", "left_semi")
    got = ingest.apply_pending(whole, spark.createDataFrame([(p,) for p in change], "path string"), read, lambda: None)
    assert same(got, extract.extract(scanned(spark, after))) == []


def test_changes_of_changes(spark):
    r = random.Random(4)
    names = [f"m{i}" for i in range(5)]

    def made(i):
        body = "".join(f"  def {r.choice(('self.', ''))}{m}\n    v = {r.choice(('1', chr(34) + 'a' + chr(34), f'K{r.randrange(5)}.new', f'K{r.randrange(5)}.{r.choice(names)}'))}\n    v{r.choice(('', '.' + r.choice(names)))}\n  end\n" for m in r.sample(names, 3))
        return f"class K{i}\n{body}end\nw{i} = K{r.randrange(5)}.{r.choice(names)}.{r.choice(names)}\n"

    files = {f"k{i}.rb": made(i) for i in range(5)}
    f = extract.extract(scanned(spark, files))
    for _ in range(1):
        change = {f"k{i}.rb": made(i) for i in r.sample(range(5), 2)}
        files |= change
        now = dict(files)
        f = ingest.apply_pending(f, spark.createDataFrame([(p,) for p in change], "path string"), lambda paths, now=now: scanned(spark, now).join(paths, "path", "left_semi"), lambda: None)
    assert same(f, extract.extract(scanned(spark, files))) == []


@pytest.mark.parametrize("size", [2])
def test_batches_of_any_size_as_a_whole_scan(spark, tmp_path, size):
    root = tmp_path / "src"
    root.mkdir()
    for p, t in FILES.items():
        (root / p).write_text(t)
    ingest.ingest(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=size).awaitTermination()
    assert same(ingest.ingested(spark, str(tmp_path / "out")), extract.extract(scan.scan(spark, str(root)))) == []


def test_core_types_added_later(spark):
    table = {"Gem": {"String": "shine"}}
    files = {"g.rb": "g = Gem.new\nh = g.shine\n"}
    f = extract.extract(scanned(spark, files))
    assert types(f)["g.rb", "h"][0] is None
    assert types(core_types.with_core_types(f, table))["g.rb", "h"] == ("String", 55, 1)
