"""From fact tables to calls: name, type and call resolution over all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidgraph.functions import paths
from lucidgraph.operators import bindings, scopes, types
from lucidgraph.operators.recursion import ancestors, first_by, written
from lucidgraph.sources import import_paths

_TYPE_KINDS = ("class", "interface", "enum")


def rewrite_constructor_calls(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """calls: symbol, kind. Function calls whose callee is a class become constructor calls. classes: symbol."""
    marked = calls.join(classes.select("symbol").distinct().withColumn("_class", F.lit(True)), "symbol", "left")
    kind = F.when((F.col("kind") == "function_call") & F.col("_class"), "constructor_call").otherwise(F.col("kind"))
    return marked.withColumn("kind", kind).drop("_class")


class Resolution:
    """Derived tables of one set of facts. Each is computed once and written."""

    def __init__(self, facts: dict[str, DataFrame], files: DataFrame):
        self.scope, self.definition, self.reference, self.imports, self.collection = (facts[k] for k in ("scope", "definition", "reference", "import_def", "function_collection"))
        self.files = files.select("path").distinct()
        self.up = written(ancestors(self.scope.select(F.col("scope_id").alias("id"), F.col("parent_id").alias("parent"))))
        self.kinds = written(self.definition.select("symbol_id", "kind", "name", "owner_id"))
        self._names()
        self._types()
        self._calls()

    # names

    def _names(self) -> None:
        """import targets, exports and bindings"""
        asked = self.imports.select(F.col("symbol_id").alias("id"), F.col("file_path").alias("file"), F.col("import_path").alias("module"), paths.detect_language(F.col("file_path")).alias("language"), "original_name").dropDuplicates(["id"])
        found = written(import_paths.import_targets(asked.drop("original_name"), self.files))
        beside = found.join(asked.filter("language = 'python' and original_name is not null").select("id", F.col("original_name").alias("name")), "id")
        sub = import_paths.submodules(beside.select("id", "path", "name"), self.files).withColumnRenamed("path", "submodule_path")
        found = found.filter("found").select("id", F.col("path").alias("resolved_path")).join(sub, "id", "full")
        imports = written(self.imports.join(found, self.imports["symbol_id"] == F.col("id"), "left").drop("id"))
        local = self.definition.filter("is_exported").select(F.col("file_path").alias("file"), F.col("name").alias("export_name"), F.col("symbol_id").alias("symbol"), "kind", F.lit(False).alias("is_reexport"), F.lit("python").alias("language"), F.col("start_line").alias("line"))
        again = imports.filter("is_reexport and import_kind = 'named' and resolved_path is not null")
        passed = again.select(F.col("file_path").alias("file"), F.col("name").alias("export_name"), F.col("symbol_id").alias("symbol"), F.lit("import").alias("kind"), F.lit(True).alias("is_reexport"), F.lit("python").alias("language"), F.col("start_line").alias("line"))
        exports, self.export_conflicts = bindings.resolve_exports(local.unionByName(passed))
        self.exports = exports = written(exports)
        chains = again.select(F.col("file_path").alias("file"), F.col("name").alias("export_name"), "symbol_id", F.col("resolved_path").alias("to_file"), F.col("original_name").alias("to_name"))
        chains = chains.join(exports.filter("is_reexport").select(F.col("symbol").alias("symbol_id")), "symbol_id", "left_semi")
        targets = written(bindings.export_targets(exports, chains.select("file", "export_name", "to_file", "to_name")))
        to = targets.select(F.col("file").alias("resolved_path"), F.col("export_name").alias("original_name"), F.col("symbol").alias("target"))
        own = F.when((F.col("import_kind") == "namespace") & F.col("resolved_path").isNotNull() | F.col("submodule_path").isNotNull(), F.col("symbol_id"))
        module = F.when(F.col("import_kind") == "namespace", F.col("resolved_path")).otherwise(F.col("submodule_path"))
        self.import_target = written(imports.join(to, ["resolved_path", "original_name"], "left").withColumn("symbol", F.coalesce("target", own)).withColumn("module_path", F.when(F.col("target").isNull(), module)))
        self.targets = targets
        scoped = self.definition.filter(~F.col("kind").isin("method", "constructor", "property"))
        locals_ = bindings.scope_bindings(scoped.select(F.col("defining_scope_id").alias("scope"), "name", F.col("symbol_id").alias("symbol"), "ord")).select("scope", "name", "symbol", F.lit(0).alias("layer"))
        imported = self.import_target.groupBy(F.col("defining_scope_id").alias("scope"), "name").agg(F.max_by("symbol", "ord").alias("symbol")).withColumn("layer", F.lit(1))
        self.bindings = written(locals_.unionByName(imported))

    def resolve(self, wanted: DataFrame) -> DataFrame:
        """wanted: ref, scope, name. With symbol."""
        return bindings.lexical_resolve(wanted, self.up, self.bindings)

    # types

    def _types(self) -> None:
        defs = self.definition
        spread = defs.filter(F.col("kind").isin(*_TYPE_KINDS)).select(F.col("symbol_id").alias("type"), F.col("defining_scope_id").alias("scope"), F.posexplode("extends").alias("ord", "name"))
        keyed = spread.withColumn("ref", F.struct("type", "ord"))
        known = self.kinds.filter(F.col("kind").isin(*_TYPE_KINDS)).select(F.col("symbol_id").alias("symbol"))
        self.parents = written(self.resolve(keyed).join(known, "symbol", "left_semi").select("type", "ord", F.col("symbol").alias("parent")))
        owned = defs.filter(F.col("kind").isin("method", "property") & F.col("owner_id").isNotNull())
        self.members = written(bindings.member_index(owned.select(F.col("owner_id").alias("type"), "name", F.col("symbol_id").alias("member"), (F.col("kind") == "property").alias("is_property"), "ord")))
        all_types = self.kinds.filter(F.col("kind").isin(*_TYPE_KINDS)).select(F.col("symbol_id").alias("type"))
        self.lookup = written(types.member_lookup(all_types, types.split_parents(self.parents), self.members))
        self.subtypes = written(types.transitive_subtypes(self.parents))
        ctors = defs.filter("kind = 'constructor'").select(F.col("owner_id").alias("type"), F.col("symbol_id").alias("ctor"))
        self.constructors = written(types.nearest_constructor(all_types, self.parents, ctors))
        named = defs.filter("type_name is not null").select(F.col("symbol_id").alias("ref"), F.col("defining_scope_id").alias("scope"), F.regexp_replace("type_name", r"^(Optional\[)?['\"]?([A-Za-z_][A-Za-z0-9_]*).*$", "$2").alias("name"))
        made = defs.filter("initialized_from_call is not null").select(F.col("symbol_id").alias("ref"), F.col("defining_scope_id").alias("scope"), F.col("initialized_from_call").alias("name"))
        annotated = self.resolve(named).join(known, "symbol", "left_semi").select(F.col("ref").alias("symbol"), F.col("symbol").alias("type"))
        called = written(self.resolve(made).filter("symbol is not null").select("ref", "symbol"))
        built = called.join(known, "symbol", "left_semi").select(F.col("ref").alias("symbol"), F.col("symbol").alias("type"))
        returns = defs.filter("kind = 'function' and return_type is not null").select(F.col("symbol_id").alias("symbol"), F.col("defining_scope_id").alias("scope"), F.regexp_replace("return_type", r"^['\"]?([A-Za-z_][A-Za-z0-9_]*).*$", "$1").alias("name"))
        through = called.join(returns, "symbol").select("ref", "scope", "name")
        inferred = self.resolve(through).join(known, "symbol", "left_semi").select(F.col("ref").alias("symbol"), F.col("symbol").alias("type"))
        self.type_of = written(types.type_bindings(built, annotated, inferred))

    # calls

    def _calls(self) -> None:
        refs = self.reference.withColumn("ref", F.concat_ws("#", "file_path", "ord"))
        calls = refs.filter(F.col("kind").isin("function_call", "method_call", "self_reference_call"))
        plain = calls.filter("kind = 'function_call'").select("ref", F.col("scope_id").alias("scope"), "name")
        plain = written(self.resolve(plain).join(self.kinds.select(F.col("symbol_id").alias("symbol"), F.col("kind").alias("symbol_kind")), "symbol", "left"))

        classes = plain.filter(F.col("symbol_kind").isin(*_TYPE_KINDS)).select("ref", F.col("symbol").alias("type"))
        ctor = classes.select("ref", F.col("type").alias("target")).unionByName(classes.join(self.constructors, "type").select("ref", F.col("ctor").alias("target"))).withColumn("call_type", F.lit("constructor"))
        functions = plain.filter("symbol_kind = 'function'").select("ref", F.col("symbol").alias("target"), F.lit("function").alias("call_type"))
        holders = plain.filter(F.col("symbol_kind").isin("variable", "constant", "parameter"))
        instance = holders.join(self.type_of, "symbol").join(self.lookup.filter("name = '__call__'").select("type", "member"), "type").select("ref", F.col("member").alias("target"), F.lit("method").alias("call_type"))
        stored = self._stored()
        source = self.definition.filter("collection_source is not null").select(F.col("symbol_id").alias("symbol"), F.col("defining_scope_id").alias("scope"), F.col("collection_source").alias("name"))
        source = self.resolve(source.withColumnRenamed("symbol", "ref")).select(F.col("ref").alias("symbol"), F.col("symbol").alias("collection"))
        dispatched = types.collection_targets(holders.join(source, "symbol").filter("collection is not null").select(F.col("ref").alias("call"), "collection"), stored).select(F.col("call").alias("ref"), "target", F.lit("function").alias("call_type"))

        typed = written(self._receivers(calls.filter("kind <> 'function_call'")))
        iface = self.kinds.filter("kind = 'interface'").select(F.col("symbol_id").alias("type"))
        wanted = typed.select(F.col("ref").alias("call"), "type", "name")
        by_iface = types.interface_dispatch(wanted.join(iface, "type", "left_semi"), self.subtypes, self.members)
        by_class = types.class_dispatch(wanted.join(iface, "type", "left_anti"), self.subtypes, self.members, self.lookup)
        callables = self.kinds.filter(F.col("kind").isin("method", "function")).select(F.col("symbol_id").alias("target"))
        methods = by_iface.unionByName(by_class).join(callables, "target", "left_semi").select(F.col("call").alias("ref"), "target", F.lit("method").alias("call_type"))
        in_module = self.module_calls.select("ref", F.col("symbol").alias("target"), "call_type")

        edges = ctor.unionByName(functions).unionByName(instance).unionByName(dispatched).unionByName(methods).unionByName(in_module).distinct()
        place = refs.select("ref", "file_path", "ord", "name", "scope_id", "start_line", "start_column")
        callers = scopes.enclosing(self.scope.select(F.col("scope_id").alias("id"), F.col("parent_id").alias("parent")), self.scope.select(F.col("scope_id").alias("id"), F.col("type").alias("kind")), ["function", "method", "constructor", "module"])
        callers = callers.select(F.col("id").alias("scope_id"), F.col("enclosing").alias("caller_scope_id"))
        self.call = written(edges.join(place, "ref").join(callers, "scope_id", "left"))

        lambdas = self.definition.filter("callback.is_callback").select(F.col("symbol_id").alias("target"), "file_path", F.col("callback.receiver_line").alias("start_line"), F.col("callback.receiver_column").alias("start_column"))
        starts = calls.select("file_path", "start_line", "start_column", "scope_id").distinct()
        self.callback = written(lambdas.join(starts, ["file_path", "start_line", "start_column"]).join(callers, "scope_id", "left").select("target", "caller_scope_id").distinct())
        self._indirect(refs, stored)

    def _stored(self) -> DataFrame:
        """collection, function, spread: what function collections hold."""
        held = self.collection.select("collection_id", "scope_id", "member_ord", "member_key", "stored_function_id", "stored_reference")
        named = self.resolve(held.filter("stored_reference is not null").select(F.struct("collection_id", "member_ord").alias("ref"), F.col("scope_id").alias("scope"), F.col("stored_reference").alias("name")))
        named = named.join(self.kinds.select(F.col("symbol_id").alias("symbol"), "kind"), "symbol")
        direct = held.filter("stored_function_id is not null").select(F.col("collection_id").alias("collection"), F.col("stored_function_id").alias("function"), F.lit(None).cast("string").alias("spread"))
        fn = F.when(F.col("kind") == "function", F.col("symbol"))
        spread = F.when(F.col("kind").isin("variable", "constant"), F.col("symbol"))
        return written(direct.unionByName(named.select(F.col("ref.collection_id").alias("collection"), fn.alias("function"), spread.alias("spread"))))

    def _receivers(self, calls: DataFrame) -> DataFrame:
        """ref, type, name of method calls whose receiver has a type. Sets module_calls, those on imported modules."""
        base = calls.select("ref", "scope_id", "kind", "keyword", F.col("property_chain")[0].alias("base"), F.slice("property_chain", 2, F.size("property_chain") - 2).alias("chain"), "name")
        owner = self.definition.filter(F.col("kind").isin(*_TYPE_KINDS)).select(F.col("body_scope_id").alias("ancestor"), F.col("symbol_id").alias("class"))
        inside = self.up.join(owner, "ancestor").groupBy(F.col("id").alias("scope_id")).agg(F.min_by("class", "dist").alias("class"))
        own = base.filter("kind = 'self_reference_call'").join(inside, "scope_id")
        first = types.split_parents(self.parents).filter("not is_interface").select(F.col("type").alias("class"), "parent")
        own = own.join(first, "class", "left").select("ref", F.when(F.col("keyword") == "super", F.col("parent")).otherwise(F.col("class")).alias("type"), "chain", "name")
        named = self.resolve(base.filter("kind = 'method_call'").select("ref", F.col("scope_id").alias("scope"), F.col("base").alias("name"), "chain", F.col("name").alias("method")))
        named = written(named.filter("symbol is not null").select("ref", "symbol", "chain", F.col("method").alias("name")))
        module = self.import_target.filter("module_path is not null").select(F.col("symbol_id").alias("symbol"), F.col("module_path").alias("file"))
        exported = self.targets.select("file", F.col("export_name").alias("name"), F.col("symbol").alias("_found")).join(self.kinds.select(F.col("symbol_id").alias("_found"), "kind"), "_found")
        called = named.filter(F.size("chain") == 0).join(module, "symbol").join(exported, ["file", "name"]).select("ref", F.col("_found").alias("symbol"), "kind")
        made = called.filter(F.col("kind").isin(*_TYPE_KINDS)).join(self.constructors.select(F.col("type").alias("symbol"), "ctor"), "symbol", "left")
        kind = F.when(F.col("kind") == "function", "function").otherwise("constructor")
        self.module_calls = written(called.filter(F.col("kind").isin("function", *_TYPE_KINDS)).select("ref", "symbol", kind.alias("call_type")).unionByName(made.filter("ctor is not null").select("ref", F.col("ctor").alias("symbol"), F.lit("constructor").alias("call_type"))))
        is_type = self.kinds.filter(F.col("kind").isin(*_TYPE_KINDS)).select(F.col("symbol_id").alias("symbol"), F.col("symbol_id").alias("_self"))
        of = named.join(self.type_of, "symbol", "left").join(is_type, "symbol", "left").select("ref", F.coalesce("type", "_self").alias("type"), "chain", "name")
        now, done = written(own.unionByName(of).filter("type is not null")), None
        while True:  # one member of each chain a round
            ready = now.filter(F.size("chain") == 0).select("ref", "type", "name")
            done = ready if done is None else done.unionByName(ready)
            rest = now.filter(F.size("chain") > 0).withColumn("_m", F.col("chain")[0])
            if rest.isEmpty():
                break
            step = rest.join(self.lookup.select("type", F.col("name").alias("_m"), "member"), ["type", "_m"]).join(self.type_of.select(F.col("symbol").alias("member"), F.col("type").alias("_next")), "member")
            now = written(step.select("ref", F.col("_next").alias("type"), F.slice("chain", F.lit(2), F.size("chain")).alias("chain"), "name"))
        return done

    def _indirect(self, refs: DataFrame, stored: DataFrame) -> None:
        """function, reason, read_at: functions read as values, or held by a collection that is read."""
        reads = self.resolve(refs.filter("kind = 'variable_reference'").select("ref", F.col("scope_id").alias("scope"), "name"))
        reads = written(reads.join(self.kinds.select(F.col("symbol_id").alias("symbol"), "kind"), "symbol").select("ref", "symbol", "kind"))
        values = reads.filter("kind = 'function'").select(F.col("symbol").alias("function"), F.lit("function_reference").alias("reason"), F.col("ref").alias("read_at"))
        held = types.collection_targets(reads.filter(F.col("kind").isin("variable", "constant")).select(F.col("ref").alias("call"), F.col("symbol").alias("collection")), stored)
        held = held.select(F.col("target").alias("function"), F.lit("collection_read").alias("reason"), F.col("call").alias("read_at"))
        self.indirect = written(first_by(values.unionByName(held), ["function"], [F.col("reason"), F.col("read_at")]))
