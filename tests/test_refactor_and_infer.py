from symdex.facts import Facts
from symdex.operators import infer
from symdex.operators import refactor as X

CODE = "class A\n  def run(x, y = 2)\n    total = x + y\n    puts total\n    puts \"done\"\n  end\nend\n"


def test_edits():
    got = X.apply_edits(CODE, X.extract_method(CODE, 3, 4, "say"))
    assert got == "class A\n  def run(x, y = 2)\n    total = x + y\n    say(total)\n  end\n\n  def say(total)\n    puts total\n    puts \"done\"\n  end\nend\n"
    assert "    extracted = x + y\n    total = extracted\n" in X.apply_edits(CODE, X.extract_variable(CODE, 2, 12, 17))
    assert X.apply_edits(CODE, X.extract_constant(CODE, 4, 9, 15)).startswith('class A\n  EXTRACTED = "done"\n')
    assert "    puts (x + y)\n" in X.apply_edits(CODE, X.inline_variable(CODE, 2)) and "total" not in X.apply_edits(CODE, X.inline_variable(CODE, 2))
    assert "puts 'done'" in X.apply_edits(CODE, X.convert_string_style(CODE, 4, 10))
    assert X.convert_string_style('x = "a#{b}"', 0, 6) == [] and X.extract_method(CODE, 90, 91) == [] and X.inline_variable(CODE, 0) == []


def test_folds_and_documents(spark):
    text = "# a\n# b\nclass A\n  def x\n    y = <<~SQL\n      end\n    SQL\n  end\n  def z = 1\nend\n"
    assert X.folding_ranges(text) == [(0, 1, "comment"), (2, 9, "region"), (3, 7, "region"), (4, 6, "heredoc")]
    df = spark.createDataFrame([("a.rb", CODE), ("b.rb", None)], "path string, text string")
    assert {r["path"]: r["text"] for r in X.refactor(df, "inline_variable", line=2).collect()}["b.rb"] is None
    assert X.folds(df).count() == 2


def test_inference(spark, facts):
    chains = spark.createDataFrame([(1, "User", ["name", "upcase", "length"]), (2, "User", ["nothing"]), (3, "Order", ["total"]), (4, "String", ["split", "join"])], "key bigint, receiver string, methods array<string>")
    got = {r["key"]: (r["type"], r["confidence"]) for r in infer.chain_types(facts, chains).collect()}
    assert got == {1: ("Integer", 30), 3: ("Integer", 55), 4: ("String", 38)}
    places = spark.createDataFrame([(2, "x", 4), (2, "x", 9), (2, "x", 1)], "file_id bigint, name string, line int")
    assert sorted((r["line"], r["type_hint"]) for r in infer.best_type_before(facts, places).collect()) == [(1, None), (4, "Integer | String"), (9, "Float")]
    named = {r["line"]: r["type"] for r in infer.type_by_name(facts, spark.createDataFrame([(2, "x", 1), (1, "y", 2)], "file_id bigint, name string, line int")).collect()}
    assert named == {1: "Float", 2: "Hash"}
    schema = "create_table \"user_stories\" do |t|\n  t.string \"title\"\n  t.bigint :points\nend\nt.string \"stray\"\n"
    lines = Facts.from_rows(spark, lines=[dict(file_id=1, n=n, text=t) for n, t in enumerate(schema.split("\n"), 1)]).lines
    assert [(r["model"], r["column"], r["type"]) for r in infer.schema_columns(lines).orderBy("line").collect()] == [("UserStory", "title", "String"), ("UserStory", "points", "Integer")]
    merged = {(r["file_id"], r["name"], r["line"]): r["type_hint"] for r in infer.inferred_variables(facts).collect()}
    assert merged[1, "first", 5] == "String" and merged[2, "y", 5] == "Hash"
