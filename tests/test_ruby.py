"""Ruby texts: statements over several lines, blocks, strings that look like code, and declarations."""

import pytest

from symdex.sources import parsers
from symdex.sources.ruby_text import cover, openings, statements


def symbols(text, kind=None):
    return [(s["name"], s["kind"], s["line"], s["end_line"], s["parent_name"]) for s in parsers.parse_ruby(text)["symbols"] if kind in (None, s["kind"])]


def test_cover_keeps_places_and_hides_what_is_no_code():
    text = "x = \"end #{a(\"}\")} # no\" # class A\ny = <<~SQL + 'end'\n  def not_code\n  SQL\nz = %w[end do] if a / b > 1\n=begin\nclass B\n=end\nr = /end#\\/ do/\nclass << self\n  A << b\n__END__\ndef c\n"
    code = cover(text)
    assert len(code) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
    assert "end" not in code and "class B" not in code and "def" not in code and "class << self" in code and "a / b > 1" in code and "A << b" in code


def test_statements_join_lines():
    got = [" ".join(s.said.split()) for s in statements("foo(1,\n  2)\na = b +\n  c; d\nlist\n  .map { |x| x }\n  &.first\nrun do |a,\n        b|\n  y\nend\n")]
    assert got == ["foo(1, 2)", "a = b + c", "d", "list .map { |x| x } &.first", "run do |a, b|", "y", "end"]


@pytest.mark.parametrize("code, want", [
    ("x = 1 if y", []), ("if y", ["block"]), ("x = if y", ["block"]), ("while a do", ["block"]), ("list.each do |x|", ["block"]), ("def a = 1", []), ("def a(b) = 1", []), ("def a=(b)", ["def"]), ("def ==(o)", ["def"]),
    ("begin", ["block"]), ("return unless z", []), ("class A", ["class"]), ("x.class", []), ("h = {if: 1, end: 2}", []), ("end.join", ["end"]), ("class A; end", ["class", "end"]), ("y = case z", ["block"]), ("private def a", ["def"]),
])
def test_what_a_statement_opens(code, want):
    assert openings(code) == want


def test_methods_over_several_lines_and_nesting():
    text = """class Long < Base
  def long(
    a,
    b = {x: [1, 2]},
    *rest, key:,
    opt: nil, **more, &blk
  )
    sql = <<~SQL
      end
      def fake; end
    SQL
    if a then b end
    return 1 if rest
    items.each do |i|
      puts i unless i.nil?
    end
    value = case a
            in Integer => n then n
            when 2 then 3
            end
    begin
      risky
    rescue ArgumentError, IOError => e
      raise
    ensure
      done
    end
    @memo ||= compute(1, "a,b", [2, 3])
  end

  def short = 42
  def self.build(x) = new(x)

  class << self
    def inner; end
    private

    def hidden
    end
  end

  private

  def secret; :x end
  public def shown; end
  attr_reader :one,
              :two
end
module After; def go; end; end
"""
    out = parsers.parse_ruby(text)
    got = {s["name"]: s for s in out["symbols"]}
    assert (got["Long"]["line"], got["Long"]["end_line"], got["Long"]["parent_name"]) == (1, 48, "Base")
    assert (got["long"]["line"], got["long"]["end_line"], got["long"]["parent_name"]) == (2, 29, "Long")
    at = out["symbols"].index(got["long"])
    assert [(p["name"], p["kind"]) for p in out["params"] if p["symbol"] == at] == [("a", "required"), ("b", "optional"), ("rest", "rest"), ("key", "keyword"), ("opt", "keyword"), ("more", "keyword_rest"), ("blk", "block")]
    assert got["short"]["return_type"] == "Integer" and got["build"]["kind"] == "classdef" and got["inner"]["kind"] == "classdef"
    assert got["hidden"]["visibility"] == got["secret"]["visibility"] == got["one"]["visibility"] == "private" and got["shown"]["visibility"] == "public" and got["two"]["kind"] == "def"
    assert "fake" not in got and (got["After"]["line"], got["go"]["parent_name"]) == (49, "After")
    bound = {v["name"]: (v["type_hint"], v["confidence"], v["line"]) for v in out["local_vars"]}
    assert bound["e"] == ("ArgumentError | IOError", 80, 23) and bound["n"] == ("Integer", 85, 18) and bound["sql"] == ("String", 0, 8) and bound["@memo"][1] == 20
    assert [v["is_block_param"] for v in out["local_vars"] if v["name"] == "i"] == [True]
    calls = {(r["name"], r["line"]): r["arg_count"] for r in out["refs"]}
    assert calls["compute", 28] == 3 and calls["puts", 15] == 1 and ("fake", 10) not in calls and calls["ArgumentError", 23] == 0
    assert {t["line"] for t in out["tokens"]} >= {0, 1, 11}


def test_declarations():
    text = """class User < ApplicationRecord
  enum :status, { active: 0, archived: 1 }, prefix: true
  enum role: [:admin, :guest]
  has_one_attached :avatar
  has_many_attached :photos
  has_rich_text :bio
  has_secure_password
  has_secure_token :api_key
  attribute :age, :integer
  store_accessor :settings, :color, :size
  composed_of :address, class_name: "Place"
  delegated_type :entryable, types: %w[Message BigComment]
  has_many :posts, -> { order(:id) }, through: :memberships,
           class_name: "Blog::Post"
  belongs_to :owner, polymorphic: true
  delegate :name, :email, to: :account, prefix: true
  before_save :normalize, :check
  validates :name, :age, presence: true
  scope :recent, -> { where(x: 1) }
  define_method(:dynamic) { |a| a }
  alias_method :old, :name
  alias other name
  accepts_nested_attributes_for :posts
  include Track, Deep::Track
  LIMIT = 10
  Point = Struct.new(:x, :y) do
    def dist; end
  end
  module_function def helper; end
  def later; end
  private :later
end
"""
    out = parsers.parse_ruby(text)
    got = {(s["name"], s["kind"]): s for s in out["symbols"]}
    for name in ("status", "active?", "archived!", "role", "admin?", "guest!", "avatar", "avatar=", "avatar_attachment", "avatar_blob", "photos_attachments", "photos_blobs", "bio?", "password=", "password_confirmation=", "authenticate", "api_key", "regenerate_api_key", "age?", "color", "size=", "address=", "message?", "big_comment", "account_name", "account_email", "dynamic", "old", "other", "posts_attributes=", "dist"):
        assert (name, "def") in got, name
    assert got["active", "scope"]["return_type"] == "[User]" and got["age", "def"]["return_type"] == "Integer" and got["address", "def"]["return_type"] == "Place"
    posts = got["posts", "association"]
    assert posts["return_type"] == "[Blog::Post]" and posts["value_snippet"] == "through:memberships" and posts["doc"] == "has_many" and got["owner", "association"]["return_type"] is None
    assert {("normalize", "callback"), ("check", "callback"), ("name", "validation"), ("age", "validation"), ("recent", "scope"), ("LIMIT", "constant"), ("User::Point", "class"), ("helper", "classdef")} <= set(got)
    assert got["dist", "def"]["parent_name"] == "User::Point" and got["x=", "def"]["parent_name"] == "User::Point" and got["later", "def"]["visibility"] == "private"
    assert [m["module_name"] for m in out["mixins"]] == ["Track", "Deep::Track"] and got["User", "class"]["end_line"] == 32


@pytest.mark.parametrize("text", ["", "\n\n", "end\nend\n", "def", "class\n", "def x(\n", "x = <<~A\n never ends", "\"", "%w[", "é = 'ü'\ndef größe; end", "a = [1,\n", "}" * 50, "((((", "class A\n def b\n", "x = /[", "=begin\n", "?", "#{", " def q; end", "if" * 200])
def test_nothing_breaks_it(text):
    out = parsers.parse_ruby(text)
    assert all(s["line"] >= 1 and s["end_line"] >= s["line"] for s in out["symbols"])


def test_indented_templates():
    haml = "%ul.list\n  - items.each do |i|\n    %li= link_to(i, path)\n    - if i\n      = i.name\n    - else\n      plain = text\n%p done\n"
    code = parsers.indented_template_code(haml)
    assert [x.index("link_to") for x in code.split("\n") if "link_to" in x] == [haml.split("\n")[2].index("link_to")]
    out = parsers.parse_ruby(code)
    assert {(r["name"], r["line"]) for r in out["refs"]} >= {("link_to", 3), ("each", 2), ("name", 5)} and not any(r["line"] in (1, 7, 8) for r in out["refs"])
    assert code.count("end") == 2
    assert parsers.indented_template_code("p = name\n| x = y\n- if a\n  b= c\n", True) == "    name\n\n  if a\n     c\n;end"


def test_files_are_parsed_once_and_scans_open_only_what_they_want(spark, tmp_path):
    from symdex.operators import tokens
    from symdex.sources import extract, scan

    root, log = tmp_path / "src", tmp_path / "log"
    log.mkdir()
    for path, text in {"app/a.rb": "class A\n  def b(x) = x.size\nend\n", "db/schema.rb": "create_table \"blog_posts\" do |t|\n  t.string \"title\"\n  t.integer :views\nend\n", "node_modules/x.rb": "class No; end", "big.rb": "#" * 500, "notes.txt": "no", "vendor/keep.rb": "class Kept; end", "vendor/gone.rb": "class Gone; end", "config/locales/en.yml": "en:\n  a: b\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    excludes, keep = scan.ignore_rules("# rules\nvendor\n!vendor/keep.rb\n")
    found = scan.scan(spark, str(root), excludes, keep, max_bytes=400)

    def counted(path, text):
        import os
        import uuid

        open(os.path.join(str(log), path.replace("/", "_") + uuid.uuid4().hex), "w").close()
        return extract.parse_file(path, text)

    facts = extract.extract(found, parse=counted)
    facts.save(str(tmp_path / "facts"))
    assert {r["name"] for r in facts.symbols.where("kind = 'class'").collect()} == {"A", "Kept"}
    assert sorted(p.name[:-32] for p in log.iterdir()) == ["app_a.rb", "config_locales_en.yml", "db_schema.rb", "vendor_keep.rb"]
    assert [tuple(r) for r in scan.oversize(spark, str(root), excludes, keep, 400).collect()] == [("big.rb", 500)]
    columns = facts.symbols.where("doc = 'column'").select("parent_name", "name", "return_type", "line").collect()
    assert sorted(map(tuple, columns)) == [("BlogPost", "title", "String", 2), ("BlogPost", "views", "Integer", 3)]
    at = facts.files.where("path = 'app/a.rb'").first()["id"]
    placed = tokens.decode(facts.sem_tokens).where(f"file_id = {at}").select("line", "col", "len").collect()
    assert sorted(map(tuple, placed)) >= [(0, 6, 1), (1, 6, 1)]


WHOLE = """class A
  def p1() = 1
  call_me
  def q; end
  other
  def n(o) o end
  def c(...) d(...) end
  alias q1 p1
  def k(a, *, **nil, &)
    puts "hi #{a.name} #{y("x #{z}")} #{1}", 'no #{w1}'
    case a
    in {n: String => s, age:} if s.ok?
      s
    in [Integer => i, *rest]
      i
    end
  end
end
"""


def test_scopes_end_with_their_methods_and_one_line_bodies_count():
    got = parsers.parse_ruby(WHOLE)
    scope = {r["name"]: r.get("scope_id") for r in got["refs"]}
    assert scope["call_me"] is None and scope["other"] is None and scope["o"] == 3 and scope["d"] == 4
    assert "q1" not in scope and scope["p1"] is None


def test_parameters_without_names():
    rows = parsers.parse_ruby(WHOLE)["params"]
    assert [(p["name"], p["kind"]) for p in rows] == [("o", "required"), ("a", "required"), ("*", "rest"), ("&", "block")]


def test_interpolations_and_patterns():
    got = parsers.parse_ruby(WHOLE)
    lines = WHOLE.split("\n")
    assert all(lines[r["line"] - 1][r["col"] :].startswith(r["name"]) for r in got["refs"])
    names = {r["name"] for r in got["refs"] if r["line"] == 10}
    assert names == {"puts", "a", "name", "y", "z"}
    assert [(v["name"], v["type_hint"]) for v in got["local_vars"]] == [("s", "String"), ("age", None), ("i", "Integer"), ("rest", None)]
    assert [(r["name"], r["line"]) for r in got["refs"] if r["line"] in (12, 14)] == [("s", 12), ("ok?", 12)]


def test_what_methods_end_with():
    code = "class A\n  def a\n    1\n  end\n  def b = A.new.a\n  def c\n    x = 1\n    x.to_s\n  end\n  def d\n    if x\n      1\n    end\n  end\n  def e\n    2\n  rescue\n    3\n  end\n  def f; return A.new; end\n  def g\n    y if z\n  end\nend\n"
    got = parsers.parse_ruby(code)
    assert {s["name"]: s.get("return_type") for s in got["symbols"]} == {"A": None, "a": "Integer", "b": None, "c": None, "d": None, "e": None, "f": "A", "g": None}
    assert [(c["name"], c["receiver"], c["methods"]) for c in got["calls"] if "symbol" in c] == [("b", "A", ["new", "a"]), ("c", "x", ["to_s"])]
