"""Operators by name: a client's tool call becomes a function of the facts and keyword arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symdex.facts import Facts
from symdex.operators import graph, health, lint, lookup, references, refactor, search, tokens

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "resolve_type": lookup.resolve_type, "class_summary": lookup.class_summary, "method_signature": lookup.method_signature, "find_callers": references.find_callers,
    "find_implementations": lookup.find_implementations, "workspace_symbols": search.workspace_symbols, "find_symbol": search.find_symbol, "search_symbols": search.search_symbols,
    "type_hierarchy": graph.type_hierarchy, "association_graph": lookup.association_graph, "route_map": search.route_map, "diagnostics": health.diagnostics,
    "get_symbol_source": lookup.symbol_source, "grep_source": references.grep_source, "i18n_lookup": search.i18n_lookup, "list_by_kind": search.list_by_kind,
    "find_unused": references.find_unused, "get_file_overview": lookup.file_overview, "list_validations": lookup.list_validations, "list_callbacks": lookup.list_callbacks,
    "concern_usage": graph.concern_usage, "find_references": references.find_references, "explain_symbol": lookup.explain_symbol, "batch_resolve": lookup.batch_resolve,
    "workspace_health": health.workspace_health, "test_summary": lookup.test_summary, "list_routes": search.list_routes, "available_code_actions": lookup.code_actions,
    "diagnostic_summary": health.diagnostic_summary, "explain_type_chain": lookup.explain_type_chain, "suggest_types": health.suggest_types, "type_coverage": health.type_coverage,
    "find_similar": search.find_similar, "refactor": refactor.refactor_file,
}

EDITOR: dict[str, Callable[..., DataFrame]] = {
    "workspace/symbol": search.ranked_symbols, "documentSymbol": lookup.document_symbols, "definition": lookup.definitions, "variable": lookup.variable_at,
    "implementation": lookup.other_implementations, "references": references.scoped_references, "typeDefinition": lookup.type_definition, "prepareTypeHierarchy": graph.prepare_type,
    "supertypes": graph.supertypes, "subtypes": graph.subtypes, "prepareCallHierarchy": references.prepare_call, "incomingCalls": references.incoming_calls,
    "outgoingCalls": references.outgoing_calls, "hover/local": lookup.hover_local, "hover/method": lookup.hover_method, "hover/name": lookup.hover_name, "hover/class": lookup.class_methods,
    "hover/i18n": search.i18n_values, "completion/dot": graph.complete_dot, "completion/namespace": search.complete_namespace, "completion/arguments": search.complete_arguments,
    "completion/all": search.complete_all, "completion/ivars": search.complete_instance_variables, "completion/globals": search.complete_globals, "completion/i18n": search.complete_i18n,
    "completion/routes": search.complete_routes, "completion/general": search.complete_general, "completion/env": search.complete_env, "completion/require": search.complete_require,
    "completion/resolve": search.complete_detail, "signatureHelp": lookup.signature_help, "inlayHint": lookup.inlay_hints, "inlayHint/parameters": lookup.parameter_hints, "documentHighlight": references.highlights,
    "scope": lookup.scope_at, "selectionRange": lookup.enclosing, "linkedEditingRange": graph.linked_editing_ranges, "codeLens": references.code_lens, "documentLink": references.document_links,
    "rename": graph.rename_occurrences, "rename/local": graph.rename_local, "prepareRename": graph.can_rename, "willRenameFiles": graph.renamed_requires, "card": lookup.class_card,
    "foldingRange": lambda f, path: refactor.folds(refactor.documents_of(f, path)),
    "semanticTokens": lambda f, path: tokens.decode(f.sem_tokens.join(f.file(path), "file_id", "left_semi")),
    "semanticTokens/range": lambda f, path, first, last: tokens.in_range(f.sem_tokens.join(f.file(path), "file_id", "left_semi"), first, last),
    "semanticTokens/delta": lambda f, path: tokens.splice(f.sem_tokens.join(f.file(path), "file_id", "left_semi")).select("start", "delete_count", "insert"),
}

ADMIN: dict[str, Callable[..., DataFrame]] = {"stats": health.stats, "kinds": health.kind_histogram, "summary": health.workspace_summary, "dump-symbols": health.dump_symbols, "check": health.check, "lint": lint.run_checks}


def run(facts: Facts, operator: str, /, **arguments) -> DataFrame:
    """The DataFrame of a named operator. Its rows are not run yet; a hierarchy or index that it needs is made and stored if the facts have none."""
    for table in (TOOLS, EDITOR, ADMIN):
        if operator in table:
            return table[operator](facts, **arguments)
    raise KeyError(operator)


def run_page(facts: Facts, operator: str, /, **arguments) -> DataFrame:
    """The page of an operator that takes a limit, each row with `has_more`: whether the limit cut the result.

    One row beyond the limit is asked for; no count of all rows is needed.
    """
    table = next((t for t in (TOOLS, EDITOR, ADMIN) if operator in t), {})
    known = inspect.signature(table[operator]).parameters
    if "limit" not in known:
        raise TypeError(f"{operator} takes no limit")
    limit = arguments.get("limit", known["limit"].default)
    rows = run(facts, operator, **arguments | {"limit": limit + 1}).withColumn("__i", F.monotonically_increasing_id())
    rows = rows.withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy()) > limit).withColumn("__n", F.row_number().over(W.orderBy("__i")))
    return rows.where(F.col("__n") <= limit).orderBy("__n").drop("__i", "__n")


#: Compositions for a client's prompts: the parts of each, by name.
PROMPTS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "class-overview": lambda f, name: {"card": lookup.class_card(f, name), "summary": lookup.class_summary(f, name), "hierarchy": graph.type_hierarchy(f, name)},
    "trace-callers": lambda f, name: {"callers": references.find_callers(f, name), "incoming": references.incoming_calls(f, name)},
    "find-bugs": lambda f, path: {"findings": lint.run_checks(f).join(f.file(path), "file_id"), "overview": lookup.file_overview(f, path)},
}
