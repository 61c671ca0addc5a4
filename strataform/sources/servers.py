"""Tool-server configurations inside a tree: JSON and the line subset of TOML, one row per server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions import paths

#: Configuration files of the agents.
JSON_FILES = {".cursor/mcp.json": "cursor", ".mcp.json": "claude-code"}
TOML_FILE = ".codex/config.toml"
COLUMNS = ["repo", "path", "agent", "ord", "name", "transport", "command", "args", "url", "env_keys", "scopes", "parse_error"]


def path_arguments(args: Column) -> Column:
    """Arguments that look like paths."""
    return F.filter(args, lambda a: ~a.rlike(r"^[-@]|://|^npx\z") & a.rlike(r"^[/~$]|[/\\]|^\.\.?\z"))


def is_filesystem_server(command: Column, args: Column) -> Column:
    return F.lower(F.concat_ws(" ", command, F.array_join(args, " "))).contains("server-filesystem")


def scope_class(scope: Column, root: Column) -> Column:
    """broad, outside, ok or unknown; a scope is judged by its text alone, with . and .. folded."""
    s = F.trim(scope)
    real = F.concat(F.lit("/"), paths.join_path(F.lit(""), s))
    return (
        F.when(s == "", "unknown")
        .when(s.isin("/", "~", "$HOME", "${HOME}") | s.rlike(r"^(~|\$HOME|\$\{HOME\})/"), "broad")
        .when((s == "..") | s.startswith("../"), "outside")
        .when(s.startswith("/"), F.when((real == root) | real.startswith(F.concat(root, F.lit("/"))), "ok").otherwise("outside"))
        .otherwise("ok")
    )


def json_servers(files: DataFrame) -> DataFrame:
    """Servers of the JSON files; a file that is no JSON is one row named (malformed), an entry that is no object a row with an error."""
    agent = F.col("path")
    agents = F.create_map(*[F.lit(x) for kv in JSON_FILES.items() for x in kv])
    f = files.where(F.col("path").isin(*JSON_FILES) & F.col("text").isNotNull() & ~F.col("is_empty"))
    f = f.select("repo", "path", agents[agent].alias("agent"), F.try_parse_json("text").alias("v"))
    entries = f.withColumn("m", F.try_variant_get("v", "$.mcpServers", "map<string,variant>"))
    bad = entries.where("v is null").select("repo", "path", "agent", F.lit(0).alias("ord"), F.lit("(malformed)").alias("name"), F.lit(None).cast("variant").alias("e"), F.lit("not JSON").alias("parse_error"))
    some = entries.where("m is not null").select("repo", "path", "agent", F.posexplode(F.map_entries("m")).alias("ord", "kv"))
    ok = F.try_variant_get(F.col("kv.value"), "$", "map<string,variant>").isNotNull()
    rows = some.select("repo", "path", "agent", "ord", F.col("kv.key").alias("name"), F.col("kv.value").alias("e"), F.when(~ok, "Server entry is not an object").alias("parse_error"))
    get = lambda name, kind="string": F.try_variant_get("e", f"$.{name}", kind)
    typed = rows.unionByName(bad).withColumns({"command": get("command"), "args": get("args", "array<string>"), "url": get("url"), "type": F.lower(get("type"))})
    transport = (
        F.when(F.col("type").isin("http", "streamable-http"), "http")
        .when(F.col("type") == "sse", "sse")
        .when((F.col("type") == "stdio") | F.col("command").isNotNull(), "stdio")
        .when(F.col("url").isNotNull(), "http")
        .otherwise("unknown")
    )
    env = F.array_sort(F.map_keys(get("env", "map<string,variant>")))
    return typed.withColumns({"transport": transport, "env_keys": env, "scopes": _scopes()}).select(*COLUMNS)


def _scopes() -> Column:
    found = path_arguments(F.col("args"))
    return F.when(is_filesystem_server(F.col("command"), F.col("args")), found).otherwise(F.filter(found, lambda s: s.startswith("/") | s.startswith("~")))


def toml_servers(files: DataFrame) -> DataFrame:
    """Servers of the TOML file: the lines below a header belong to it up to the next one; a repeated header is a server of its own."""
    f = files.where((F.col("path") == TOML_FILE) & F.col("text").isNotNull())
    lines = f.select("repo", "path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    lines = lines.where(~F.col("line").rlike(r"^(#|\z)"))
    header = F.regexp_extract("line", r"(?i)^\[mcp_servers\.([^\]]+)\]\z", 1)
    w = Window.partitionBy("repo", "path").orderBy("pos")
    own = lines.withColumn("name", F.when(header != "", header)).withColumn("ord", F.count("name").over(w) - 1)
    value = lambda k, close=r'"([^"]*)"': F.max(F.when(F.col("line").rlike(rf"(?i)^{k}\s*=\s*{close}"), F.regexp_extract("line", rf"(?i)^{k}\s*=\s*{close}", 1)))
    grouped = own.where("ord >= 0").groupBy("repo", "path", "ord").agg(
        F.max("name").alias("name"),
        value("command").alias("command"),
        value("url").alias("url"),
        value("args", r"\[(.*)\]").alias("args"),
        value("env", r"\{([^}]*)\}").alias("env"),
    )
    typed = grouped.withColumns(
        {
            "agent": F.lit("codex"),
            "args": F.when(F.col("args").isNotNull(), F.regexp_extract_all("args", F.lit('"([^"]*)"'), F.lit(1))),
            "env_keys": F.array_sort(F.array_distinct(F.regexp_extract_all("env", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*="), F.lit(1)))),
            "transport": F.when(F.col("command") != "", "stdio").when(F.col("url") != "", "http").otherwise("unknown"),
            "ord": F.col("ord").cast("int"),
            "parse_error": F.lit(None).cast("string"),
        }
    )
    files_only = F.when(is_filesystem_server(F.col("command"), F.col("args")), path_arguments(F.col("args")))
    return typed.withColumn("scopes", files_only).select(*COLUMNS)


def servers(files: DataFrame) -> DataFrame:
    return json_servers(files).unionByName(toml_servers(files))


def duplicate_servers(rows: DataFrame) -> DataFrame:
    """Names that an agent has twice or more, rows with errors and names in brackets left out."""
    good = rows.where(F.col("parse_error").isNull() & ~F.col("name").startswith("("))
    return good.groupBy("repo", "agent", "name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1")
