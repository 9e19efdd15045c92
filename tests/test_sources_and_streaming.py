"""Parsers, extraction from files, and change feeds."""

from datetime import datetime, timedelta

from symdex.operators import lookup, references
from symdex.sources import extract, parsers, scan
from symdex.streaming import changes as C


def test_locale():
    rows = parsers.parse_locale("en:\n  # c\n  user:\n    name: \"User Name\" # x\n    'age': 3 # years\n    empty:\n  top: *ref\nde:\n  user:\n    name: Nutzer\n")
    assert [(r["locale"], r["key"], r["value"]) for r in rows] == [("en", "user.name", "User Name"), ("en", "user.age", "3"), ("en", "top", "*ref"), ("de", "user.name", "Nutzer")]


def test_routes():
    rows = parsers.parse_routes("Rails.application.routes.draw do\n  root 'home#show'\n  namespace :api do\n    resources :users, only: [:index, :show] do\n      resources :posts, except: [:destroy, :new, :edit, :update, :create]\n      get :stats, on: :member\n    end\n  end\n  get '/health', to: 'health#index'\n  resource :profile, only: :show\nend\n")
    got = [(r["http_method"], r["path_pattern"], r["controller"], r["action"]) for r in rows]
    assert got == [
        ("GET", "/", "home", "show"), ("GET", "/api/users", "api/users", "index"), ("GET", "/api/users/:id", "api/users", "show"), ("GET", "/api/users/:user_id/posts", "api/posts", "index"),
        ("GET", "/api/users/:user_id/posts/:id", "api/posts", "show"), ("GET", "/api/users/:user_id/stats", "api/users", "stats"), ("GET", "/health", "health", "index"), ("GET", "/profile", "profile", "show"),
    ]
    assert [parsers.singular(x) for x in ("people", "categories", "addresses", "wolves", "users", "bus")] == ["person", "category", "address", "wolf", "user", "bu"]


def test_signatures():
    got = parsers.parse_signatures("# A dog.\nclass Dog < Animal\n  attr_reader name: String\n  # Barks.\n  def bark: (Integer times, ?loud: bool, *String rest) -> String\n         | () -> nil\n  def self.build: () -> Dog\n  class Tag\n  end\nend\n")
    assert [(s["name"], s["kind"], s["parent_name"], s.get("return_type")) for s in got["symbols"]] == [("Dog", "class", "Animal", None), ("name", "def", "Dog", "String"), ("bark", "def", "Dog", "String"), ("build", "classdef", "Dog", "Dog"), ("Tag", "class", "Dog", None)]
    assert [(p["name"], p["kind"], p["type_hint"]) for p in got["params"]] == [("times", "required", "Integer"), ("loud", "keyword", "bool"), ("rest", "rest", "String")]
    assert got["symbols"][0]["doc"] == "A dog." and got["symbols"][0]["end_line"] == 10


def test_template_keeps_places():
    text = "<p>é <%= name %></p>\n<%# no %><% if x -%>\n"
    code = parsers.template_code(text)
    assert len(code) == len(text) and code.index("name") == text.index("name") and "no" not in code and code.count("\n") == 2


def test_ruby_subset():
    got = parsers.parse_ruby("module Animals\n  class Dog\n    include Track\n    LEGS = 4\n    attr_accessor :age\n    has_many :bones, through: :yards\n    before_save :wash\n\n    # Barks.\n    def bark(times = 1, *rest, loud: false)\n      x = Dog.new\n      @name = \"Rex\"\n      x.bark(3, loud: true)\n      if x\n        wash\n      end\n    end\n\n    private\n\n    def wash; end if false\n    def self.make = 'dog'\n  end\nend\n")
    names = {(s["name"], s["kind"]): s for s in got["symbols"]}
    assert names["Animals::Dog", "class"]["parent_name"] == "Animals" and names["LEGS", "constant"]["value_snippet"] == "4"
    assert names["bark", "def"]["end_line"] == 17 and names["bark", "def"]["doc"] == "Barks." and names["bones", "association"]["return_type"] == "[Bone]"
    assert {("age", "def"), ("age=", "def"), ("wash", "callback"), ("make", "classdef")} <= set(names)
    assert [(p["name"], p["kind"]) for p in got["params"]][:3] == [("times", "optional"), ("rest", "rest"), ("loud", "keyword")]
    assert {(v["name"], v["type_hint"]) for v in got["local_vars"]} == {("x", "Dog"), ("@name", "String")}
    assert [(r["name"], r["arg_count"]) for r in got["refs"] if r["name"] == "bark"] == [("bark", 2)]
    assert got["mixins"] == [{"symbol": 1, "module_name": "Track", "kind": "include"}]
    for odd in ("", "end\nend\n", "class\n", "def", "\0\n", "x" * 5000 + "(" * 500):
        parsers.parse_ruby(odd)


def test_declared_types():
    got = parsers.parse_ruby("class A\n  # @param n [Integer, nil] how many\n  # @return [String, nil]\n  def x(n)\n  end\n  sig { params(a: Integer, b: T::Boolean).returns(T::Array[Integer]) }\n  def y(a, b)\n  end\n  sig do\n    params(c: Float)\n    .void\n  end\n  def z(c)\n  end\nend\n")
    assert [(s["name"], s.get("return_type")) for s in got["symbols"]] == [("A", None), ("x", "String | nil"), ("y", "T::Array[Integer]"), ("z", "NilClass")]
    assert [(p["name"], p["type_hint"]) for p in got["params"]] == [("n", "Integer, nil"), ("a", "Integer"), ("b", "T::Boolean"), ("c", "Float")]


def test_scan_and_extract(spark, tmp_path):
    files = {"app/user.rb": "class User < Base\n  def name\n    full\n  end\nend\n", "config/routes.rb": "resources :users\n", "config/locales/en.yml": "en:\n  a:\n    b: C\n", "sig/user.rbs": "class User\n  def age: () -> Integer\nend\n", "node_modules/x.rb": "class No\nend\n", ".git/y.rb": "class No\nend\n", "notes.txt": "no", "spec/big.rb": "class Spec\nend\n"}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    scanned = scan.scan(spark, str(tmp_path), excludes=("spec",))
    assert {r["path"] for r in scanned.collect()} == {"app/user.rb", "config/routes.rb", "config/locales/en.yml", "sig/user.rbs"}
    f = extract.extract(scanned)
    assert {(r["name"], r["kind"]) for r in f.symbols.collect()} == {("User", "class"), ("name", "def"), ("age", "def")}
    assert f.routes.count() == 7 and f.i18n_keys.first()["key"] == "a.b" and f.lines.count() == 16
    assert lookup.method_signature(f, "User#age").first()["return_type"] == "Integer"
    assert {r["path"] for r in references.find_references(f, "full").collect()} == {"app/user.rb"}


def test_gate_and_tombstones(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", 1, 1, "x", t0, 1), ("a", 3, 2, "y", t0, 2), ("a", 2, 2, "late", t0, 3), ("a", 3, 2, "same", t0, 4), ("b", 1, 1, "z", t0, 5), ("b", 2, 3, None, t0, 6), ("c", 5, 1, "q", t0, 7)]
    df = spark.createDataFrame(rows, C.CHANGE_SCHEMA)
    stored = spark.createDataFrame([("c", 9)], "uri string, version bigint")
    ok = C.accepted(df, stored)
    assert sorted(r["seq"] for r in ok.collect()) == [1, 2, 5, 6]
    assert [(r["uri"], r["text"]) for r in C.live(ok).collect()] == [("a", "y")] and [r["uri"] for r in C.tombstones(ok).collect()] == ["b"]


def test_debounce_and_rate_limit(spark):
    t0 = datetime(2024, 1, 1)
    ms = lambda n: t0 + timedelta(milliseconds=n)
    df = spark.createDataFrame([("a", i, 2, str(i), ms(t), i) for i, t in enumerate([0, 100, 200, 600, 700])], C.CHANGE_SCHEMA)
    assert sorted((r["text"], r["n"]) for r in C.debounced(df).collect()) == [("2", 3), ("4", 2)]
    req = spark.createDataFrame([("k", i * 10, i) for i in range(5)] + [("k", 1001, 9), ("z", 0, 1)], "client string, ts_ms bigint, seq bigint")
    got = {(r["client"], r["seq"]): r["allowed"] for r in C.rate_limited(req, most=3).collect()}
    assert got == {("k", 0): True, ("k", 1): True, ("k", 2): True, ("k", 3): False, ("k", 4): False, ("k", 9): True, ("z", 1): True}


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", 1, 1, "x", t0, 1), ("b", 4, 1, "p", t0, 2), ("a", 3, 2, "y", t0, 3), ("a", 2, 2, "late", t0, 4), ("b", 5, 2, "r", t0, 5), ("b", 5, 2, "again", t0, 6)]
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], C.CHANGE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    feed = tmp_path / "feed"
    feed.mkdir()
    for i in range(3):
        for p in (tmp_path / f"in/{i}").glob("*.parquet"):
            p.rename(feed / f"{i}.parquet")
    seen = []
    stream = spark.readStream.schema(spark.createDataFrame([], C.CHANGE_SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    C.run_gate(stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.extend(r["seq"] for r in df.collect())).awaitTermination(120)
    assert sorted(seen) == sorted(r["seq"] for r in C.accepted(spark.createDataFrame(rows, C.CHANGE_SCHEMA)).collect()) == [1, 2, 3, 5]


def test_rate_limit_of_one_busy_client(spark):
    """A window begins with a request; one client sends nearly all."""
    rows = [("busy", i * 7, i) for i in range(50_000)] + [("calm", i * 600, i) for i in range(9)]
    got = C.rate_limited(spark.createDataFrame(rows, "client string, ts_ms bigint, seq bigint").repartition(3), most=100, window_ms=1000).collect()
    want, start, n = {}, {}, {}
    for client, ts, seq in rows:
        if client not in start or ts - start[client] > 1000:
            start[client], n[client] = ts, 0
        n[client] += 1
        want[client, seq] = n[client] <= 100
    assert {(r["client"], r["seq"]): r["allowed"] for r in got} == want and not all(want.values())


def test_gate_state_stays_small(spark, tmp_path, monkeypatch):
    """Many batches leave few folders, and versions of long ago still hold."""
    import os

    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 3)
    src, state = tmp_path / "in", str(tmp_path / "state")
    seen = []
    for i in range(10):
        version = 1 if i == 9 else i + 5
        row = [("old" if i in (0, 9) else f"u{i % 2}", version, 2, "t", None, i)]
        spark.createDataFrame(row, C.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(C.CHANGE_SCHEMA).parquet(str(src))
        C.run_gate(stream, state, str(tmp_path / "cp"), lambda df, n: seen.extend((r["uri"], r["version"]) for r in df.collect())).awaitTermination()
    assert seen == [("old", 5), *[(f"u{i % 2}", i + 5) for i in range(1, 9)]]
    folders = [os.listdir(f"{state}/{k}") for k in ("snapshots", "changes")]
    assert len(folders[0]) <= 2 and len(folders[1]) <= 7


def test_index_command_stores_derived_tables(spark, tmp_path):
    from symdex import __main__ as command
    from symdex.facts import Facts

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rb").write_text("class A < B\n  def go\n    'x'.upcase\n  end\nend\nclass B; end\n")
    assert command.main(["index", str(tmp_path / "facts"), str(tmp_path / "src"), "--core"]) == 0
    f = Facts.load(spark, str(tmp_path / "facts"))
    assert f.has("reach") and f.has("trigrams") and ("A", "B") in {(r["root"], r["node"]) for r in f.reach.where("via = 'all'").collect()}
    assert f.files.where("is_gem").count() > 5 and f.symbols.where("name = 'go'").first()["return_type"] == "String"
    assert command.main(["index", str(tmp_path / "facts")]) == 2 and command.main(["index", "a", "b", "--other"]) == 2
