"""Types of calls, hints of parameters, routing trees, core signatures and locked packages."""

from symdex.plans import registry
from symdex.sources import core_types, extract, lockfile, parsers, scan

TREE = """class App < Roda
  hash_branch "projects" do |r|
    r.get true do
      r.post "inside"
    end
    r.on String do |name|
      r.is do
        r.get { x }
        r.delete do
          drop
        end
      end
      r.on :kind do
        r.put
      end
      r.on "vm" do
        r.post("create") { y }
      end
    end
    if admin
      r.patch
    end
  end
  route do |r|
    r.get
  end
end
"""


def test_routing_tree():
    rows = [(r["http_method"], r["path_pattern"], r["helper_name"], r["line"]) for r in parsers.parse_routing_tree(TREE, "app")]
    assert rows == [
        ("GET", "/projects", "projects_path", 3), ("GET", "/projects/:id", "projects_id_path", 8), ("DELETE", "/projects/:id", "projects_id_path", 9),
        ("PUT", "/projects/:id/:kind", "projects_id_kind_path", 14), ("POST", "/projects/:id/vm", "projects_id_vm_path", 17), ("PATCH", "/projects", "projects_path", 21), ("GET", "/", "root", 25),
    ]
    parsed = extract.parse_file("app/routes/web.rb", TREE)["routes"]
    assert {(r["controller"], r["action"]) for r in parsed} == {("web", x) for x in ("GET", "DELETE", "PUT", "POST", "PATCH")}
    assert parsers.parse_routing_tree("") == [] and parsers.parse_routing_tree("r.on do\nend\nend\nend\nr.get") != []
    assert extract.parse_file("config/routes.rb", "resources :users, only: [:index]\n")["routes"][0]["controller"] == "users"


CODE = '''class Post
  has_many :comments
  # @return [Integer]
  def size(a, b = 1, *rest)
    7
  end

  # @return [Float]
  def self.rate(x)
    1.0
  end
end

class Comment
end

def run(post)
  all = Post.where(id: 1).order(:id)
  one = all.first
  n = one.size(1, 2)
  said = n.to_s.strip
  low = "Hi".downcase.length
  made = Post.new.comments
  each_one = made.first
  r = Post.rate(2)
  lost = unknown.call
  far = "x".strip.strip.strip.strip.strip.strip
  all.each do |p|
    p.size(3, key: 4)
    p.size(5,
           6)
  end
  3.times { |i| puts(i) }
  plus = one.size + 1
  Post.rate(all, one)
end
'''


def facts_of(spark, files):
    return extract.extract(scan_rows(spark, files))


def scan_rows(spark, files):
    return spark.createDataFrame([(p, 1, 1, t) for p, t in files.items()], "path string, mtime_ms bigint, content_hash bigint, text string")


def test_types_of_calls_and_parameter_hints(spark):
    f = facts_of(spark, {"a.rb": CODE, "empty.rb": ""})
    got = {r["name"]: (r["type_hint"], r["confidence"]) for r in f.local_vars.collect()}
    assert got["all"] == ("[Post]", 38) and got["one"] == ("Post", 55) and got["low"] == ("Integer", 38)
    assert got["r"] == ("Float", 55) and got["made"] == ("[Comment]", 38) and got["p"] == ("Post", 60) and got["i"] == ("Integer", 60)
    assert got["each_one"] == ("Comment", 55) and got["lost"][0] is got["far"][0] is got["plus"][0] is None
    # a type that follows from a round's types comes with the next round, and what follows from that with the one after
    assert got["n"] == ("Integer", 55) and got["said"] == ("String", 38)
    rounds = {r["name"]: r["round"] for r in f.local_vars.collect()}
    assert (rounds["all"], rounds["one"], rounds["n"], rounds["said"], rounds["lost"]) == (1, 2, 3, 4, None)
    hints = [tuple(r) for r in registry.run(f, "inlayHint/parameters", path="a.rb", first=1, last=99).collect()]
    lines = CODE.split("\n")
    places = [(line, lines[line - 1][col], label) for line, col, label in hints]
    assert places == [(20, "1", "a:"), (20, "2", "b:"), (29, "3", "a:"), (30, "5", "a:"), (31, "6", "b:"), (35, "a", "x:")]
    assert registry.run(f, "inlayHint/parameters", path="empty.rb", first=1, last=9).count() == 0


def test_call_chains():
    chain = lambda x: parsers.call_chain(x, x)
    assert chain("User.find(1)") == {"receiver": "User", "known": None, "methods": ["find"]}
    assert chain("a&.b(c(1), 2).d { |x| x.y }.e") == {"receiver": "a", "known": None, "methods": ["b", "d", "e"]}
    assert chain("[1, 2].first")["known"] == "Array" and chain("User.find 1")["methods"] == ["find"] and chain("a.b if c")["methods"] == ["b"]
    assert chain("a.b + c") is chain("a") is chain("self.b") is chain("a.b = 1") is chain("") is chain("a.b or c") is None
    assert parsers.parse_ruby("x = Foo.new(1)\n")["local_vars"][0]["type_hint"] == "Foo"


def test_core_types(spark, facts):
    texts = core_types.signature_files({"String": {"Integer": "length", "bool": "empty?"}})
    assert texts == {"<bundled>/core/string.rbs": "class String\n  def length: () -> Integer\n  def empty?: () -> bool\nend\n"}
    table = {"String": {"Integer": "length"}, "Array": {"bool": "any?"}}
    once = core_types.with_core_types(facts, table)
    twice = core_types.with_core_types(once, table)
    rows = lambda f: sorted((r["name"], r["parent_name"], r["return_type"]) for r in f.symbols.join(f.paths(), "file_id").where("path LIKE '<bundled>/%' AND kind = 'def'").collect())
    assert rows(once) == rows(twice) == [("any?", "Array", "bool"), ("length", "String", "Integer")]
    assert twice.files.where("is_gem AND path LIKE '<bundled>/%'").count() == 2 and twice.workspace().count() == facts.workspace().count()


def test_locked_packages(spark, tmp_path):
    lock = """GIT
  remote: https://example.org/x.git
  revision: abc
  specs:
    x (0.1.0)
      rack (>= 2)

GEM
  remote: https://example.org/
  specs:
    nokogiri (1.16.0-x86_64-linux)
      racc (~> 1.4)
    rack (3.0.1)

PLATFORMS
  x86_64-linux

DEPENDENCIES
  rack (~> 3.0)
  x!
"""
    rows = lockfile.parse_lockfile(lock)
    assert [(r["name"], r["version"], r["platform"], r["source"], r["needs"]) for r in rows] == [("x", "0.1.0", None, "git", ["rack"]), ("nokogiri", "1.16.0", "x86_64-linux", "gem", ["racc"]), ("rack", "3.0.1", None, "gem", [])]
    assert rows[0]["remote"] == "https://example.org/x.git" and lockfile.parse_lockfile("") == []
    for name in ("rack-3.0.1/lib/rack.rb", "rack-2.0.0/lib/rack.rb", "nokogiri-1.16.0-x86_64-linux/a.rb"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class A; end")
    found = sorted(r["path"] for r in lockfile.scan_packages(spark, lock, str(tmp_path)).collect())
    assert found == ["nokogiri-1.16.0-x86_64-linux/a.rb", "rack-3.0.1/lib/rack.rb"]
    assert lockfile.scan_packages(spark, "", str(tmp_path)).count() == 0
    collection = "sources:\n- type: git\n  name: x\ngems:\n- name: rack\n  version: '3'\n  source:\n    type: local\n    path: sig/rack\n- name: json\nlast: 1\n"
    assert lockfile.parse_signature_lock(collection) == [("rack", "sig/rack"), ("json", None)]
    assert scan.NAME_GLOB.startswith("{")
