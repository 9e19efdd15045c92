import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "2g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def facts(spark):
    from symdex.facts import Facts

    files = [
        dict(id=1, path="app/user.rb", mtime_ms=1, content_hash=11, is_gem=False),
        dict(id=2, path="app/order.rb", mtime_ms=1, content_hash=12, is_gem=False),
        dict(id=3, path="gems/base.rb", mtime_ms=1, content_hash=13, is_gem=True),
    ]
    sym = lambda i, fid, name, kind, line, end, parent=None, **x: dict(id=i, file_id=fid, name=name, kind=kind, line=line, col=0, end_line=end, parent_name=parent, visibility="public") | x
    symbols = [
        sym(1, 1, "User", "class", 1, 20, "Base"),
        sym(2, 1, "name", "def", 2, 4, "User", return_type="String", doc="The name."),
        sym(3, 1, "full_name", "def", 5, 8, "User", return_type=""),
        sym(4, 1, "secret", "def", 9, 10, "User", visibility="private"),
        sym(5, 1, "posts", "association", 11, 11, "User", return_type="Post", doc="has_many", value_snippet="through:memberships"),
        sym(6, 1, "normalize", "callback", 12, 12, "User", doc="before_save"),
        sym(7, 2, "Order", "class", 1, 30, "User"),
        sym(8, 2, "total", "def", 2, 9, "Order", return_type="Integer"),
        sym(9, 2, "total", "def", 10, 12, "Order"),
        sym(10, 2, "test_total", "test", 13, 15, "Order"),
        sym(11, 3, "Base", "class", 1, 9),
        sym(12, 3, "Track", "module", 10, 19),
        sym(13, 3, "touch", "def", 11, 12, "Track"),
        sym(14, 3, "save", "def", 2, 3, "Base"),
        sym(15, 2, "total_sum", "def", 16, 18, "Order"),
        sym(16, 2, "Loop", "class", 40, 41, "Loop"),
    ]
    refs = [
        dict(file_id=1, name="name", line=6, col=4, scope_id=1, arg_count=0),
        dict(file_id=2, name="name", line=3, col=4, scope_id=2, arg_count=2, receiver_type="User"),
        dict(file_id=2, name="full_name", line=4, col=4, scope_id=2, arg_count=3, receiver_type="User"),
        dict(file_id=2, name="x", line=5, col=4, scope_id=2, arg_count=0),
        dict(file_id=2, name="upcase", line=6, col=4, scope_id=2, arg_count=0, receiver_type="NilClass"),
        dict(file_id=2, name="totl", line=7, col=4, scope_id=2, arg_count=0),
        dict(file_id=1, name="validates", line=3, col=2, arg_count=1),
    ]
    params = [
        dict(symbol_id=3, position=0, name="first", kind="required", type_hint="String", confidence=90),
        dict(symbol_id=2, position=0, name="style", kind="optional"),
        dict(symbol_id=2, position=1, name="rest", kind="rest"),
    ]
    var = lambda fid, name, line, col, t, c, s=None, k=None: dict(file_id=fid, name=name, line=line, col=col, type_hint=t, confidence=c, scope_id=s, class_id=k, is_block_param=False)
    local_vars = [
        var(2, "x", 3, 2, "Integer | String", 55, 2), var(2, "x", 5, 2, "Float", 90, 2), var(2, "y", 5, 10, "Hash", 85, 2), var(2, "dead", 8, 2, "", 0, 2),
        var(1, "@name", 2, 1, "String", 80, None, 1), var(1, "$debug", 1, 0, None, 0), var(1, "total_sum", 3, 0, "Integer", 60),
    ]
    mixins = [dict(class_id=1, module_name="Track", kind="include"), dict(class_id=7, module_name="Deep::Track", kind="prepend")]
    i18n = [dict(file_id=1, key="en.user.name", value="Name", locale="en"), dict(file_id=1, key="de.user.name", value="Name", locale="de")]
    routes = [dict(file_id=1, http_method="GET", path_pattern="/users", helper_name="users_path", controller="users", action="index", line=1, col=0)]
    texts = {1: ["class User < Base", "  def name(style = 1, *rest)", "  validates :name", "  end", "  def full_name(first)", "    name", "    ENV['HOME_DIR']", "  end"], 2: ["class Order < User", "require_relative 'lib/user'", "  NAME here", "  x = 1"]}
    lines = [dict(file_id=i, n=n, text=t) for i, rows in texts.items() for n, t in enumerate(rows, 1)]
    return Facts.from_rows(spark, files=files, symbols=symbols, refs=refs, params=params, local_vars=local_vars, mixins=mixins, i18n_keys=i18n, routes=routes, lines=lines)
