"""Scenes, prefabs, assemblies, addressables and events of Unity projects, as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions import ids
from symgraph.functions.text import stem

# Methods that the engine calls, and base types with their node kinds.
LIFECYCLE = [
    "Awake", "Start", "Update", "FixedUpdate", "LateUpdate", "OnEnable", "OnDisable", "OnDestroy", "OnCollisionEnter", "OnCollisionExit", "OnCollisionStay", "OnTriggerEnter", "OnTriggerExit", "OnTriggerStay", "OnMouseDown", "OnMouseUp", "OnMouseDrag",
    "OnGUI", "OnApplicationQuit", "OnApplicationPause", "OnApplicationFocus",
]
BASES = {"MonoBehaviour": "MonoBehaviour", "ScriptableObject": "ScriptableObject", "Editor": "Editor", "EditorWindow": "Editor"}
NODE = ["id", "full_name", "label", "kind"]


def types_by_text(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Id, full_name and three flags of classes whose file names a Unity base, as plain text shows it."""
    has = lambda *bases: F.coalesce(*[F.when(F.contains("content", F.lit(f": {b}")), True) for b in bases], F.lit(False))
    flags = {"is_mono": has("MonoBehaviour", "UnityEngine.MonoBehaviour"), "is_scriptable": has("ScriptableObject", "UnityEngine.ScriptableObject"), "is_editor": has("Editor", "UnityEditor.Editor")}
    rows = symbols.where("kind = 'Type' and type_name = 'Class'").join(files.select("file_path", "content"), "file_path")
    return rows.select("id", "full_name", *[v.alias(k) for k, v in flags.items()]).where("is_mono or is_scriptable or is_editor")


def is_project(files: DataFrame) -> DataFrame:
    """Repository, unity: it has both an Assets and a ProjectSettings folder."""
    has = lambda d: F.max(F.array_contains(F.split("file_path", "/"), d))
    return files.groupBy("repository").agg((has("Assets") & has("ProjectSettings")).alias("unity"))


def documents(files: DataFrame, parity: bool = False) -> DataFrame:
    """file_path, place, class_id, file_id, name, father, script_guid, owner of each document of a scene or prefab.

    A document's name is its own; with parity a GameObject takes the last name before the next one, as a reader of lines
    would. owner is the last GameObject at or before the document.
    """
    parts = files.select("file_path", F.posexplode(F.split("content", r"(?m)^--- ")).alias("place", "text")).where("text like '!u!%'")
    got = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    rows = parts.select(
        "file_path", "place", got(r"^!u!(\d+)").cast("int").alias("class_id"), got(r"&(-?\d+)").alias("file_id"), got(r"(?m)^\s*m_Name: *(\S[^\r\n]*)").alias("name"), got(r"m_Father: *\{fileID: *(-?\d+)").alias("father"),
        got(r"m_Script: *\{[^}]*guid: *(\w+)").alias("script_guid"), got(r"m_GameObject: *\{fileID: *(-?\d+)").alias("game_object"),
    )
    order = Window.partitionBy("file_path").orderBy("place")
    rows = rows.withColumn("owner", F.last(F.when(F.col("class_id") == 1, F.col("file_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if parity:
        rows = rows.withColumn("name", F.last("name", ignorenulls=True).over(Window.partitionBy("file_path", "owner").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("owner", F.coalesce("game_object", "owner"))


def objects(docs: DataFrame) -> DataFrame:
    """file_path, file_id, name, id of the GameObjects."""
    return docs.where("class_id = 1").select("file_path", "file_id", "name", ids.asset_id("GameObject", F.col("file_path"), F.coalesce("name", F.lit(""))).alias("id"))


def scene_graph(docs: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of GameObjects; Component edges to scripts (guid, id) and ChildOf edges to parents."""
    named = objects(docs)
    nodes = named.select("id", F.concat_ws("/", "file_path", "name").alias("full_name"), F.col("name").alias("label"), F.lit("GameObject").alias("kind")).dropDuplicates(["id"])
    owner = named.select("file_path", F.col("file_id").alias("owner"), F.col("id").alias("source_id"))
    used = docs.where("script_guid is not null").join(owner, ["file_path", "owner"]).join(scripts.select(F.col("guid").alias("script_guid"), F.col("id").alias("target_id")), "script_guid")
    places = docs.where("class_id in (4, 224)").select("file_path", F.col("file_id").alias("transform"), "owner", "father")
    up = places.where("father != '0'").join(places.select("file_path", F.col("transform").alias("father"), F.col("owner").alias("parent")), ["file_path", "father"])
    up = up.join(owner, ["file_path", "owner"]).join(owner.select("file_path", F.col("owner").alias("parent"), F.col("source_id").alias("target_id")), ["file_path", "parent"])
    edges = used.select("source_id", "target_id", F.lit("Component").alias("kind")).unionByName(up.select("source_id", "target_id", F.lit("ChildOf").alias("kind")))
    return nodes, edges.distinct()


def prefab_graph(docs: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beside the scene graph, a node for each prefab and InstanceOf edges from its objects."""
    nodes, edges = scene_graph(docs, scripts)
    files = docs.select("file_path").distinct().select("file_path", ids.asset_id("Prefab", F.col("file_path")).alias("prefab"))
    prefabs = files.select(F.col("prefab").alias("id"), F.col("file_path").alias("full_name"), stem(F.col("file_path")).alias("label"), F.lit("Prefab").alias("kind"))
    inst = objects(docs).join(files, "file_path").select(F.col("id").alias("source_id"), F.col("prefab").alias("target_id"), F.lit("InstanceOf").alias("kind")).distinct()
    return nodes.unionByName(prefabs), edges.unionByName(inst)


def component_totals(docs: DataFrame) -> DataFrame:
    """file_path, objects, components."""
    return docs.groupBy("file_path").agg(F.count_if(F.col("class_id") == 1).alias("objects"), F.count_if(F.col("script_guid").isNotNull()).alias("components"))


ASMDEF = "name string, references array<string>, includePlatforms array<string>, excludePlatforms array<string>, autoReferenced boolean, allowUnsafeCode boolean, defineConstraints array<string>"


def assemblies(files: DataFrame) -> DataFrame:
    """file_path and the fields of assembly definitions; bad JSON and packages are skipped."""
    rows = files.where("file_path like '%.asmdef' and not arrays_overlap(split(file_path, '/'), array('Library', 'Packages'))").select("file_path", F.from_json("content", ASMDEF, {"mode": "PERMISSIVE"}).alias("j"))
    return rows.where("j.name is not null").select("file_path", "j.*").withColumn("autoReferenced", F.coalesce("autoReferenced", F.lit(True)))


def assembly_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U7."""
    a = lambda c: ids.asset_id("Assembly", c)
    nodes = found.select(a(F.col("name")).alias("id"), F.col("name").alias("full_name"), F.col("name").alias("label"), F.lit("Assembly").alias("kind"))
    edges = found.select("name", F.explode("references").alias("to")).select(a(F.col("name")).alias("source_id"), a(F.col("to")).alias("target_id"), F.lit("AssemblyDep").alias("kind"))
    return nodes.dropDuplicates(["id"]), edges.distinct()


def addressables(files: DataFrame) -> DataFrame:
    """file_path, address, guid, asset of addressable entries; guids and paths go together by their place.

    Group and schema files are left out; a guid without a path has an empty one."""
    guids = F.regexp_extract_all("content", F.lit(r"m_AssetGuid:\s*([a-f0-9]+)"), 1)
    paths = F.slice(F.regexp_extract_all("content", F.lit(r"m_AssetPath:[^\S\n]*([^\r\n]*)"), 1), F.lit(1), F.greatest(F.size(guids), F.lit(0)))
    rows = files.where("file_path like '%.asset' and not contains(file_path, 'AssetGroups') and not contains(file_path, 'AssetGroupSchema')")
    rows = rows.select("file_path", stem(F.col("file_path")).alias("address"), F.inline(F.arrays_zip(guids.alias("guid"), paths.alias("asset"))))
    return rows.select("file_path", "address", "guid", F.expr("trim(both '\"' from coalesce(asset, ''))").alias("asset"))


def addressable_graph(found: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The package and its assets; AddressableRef edges to them, and References of .cs assets to scripts (name, id)."""
    rows = found.withColumn("a", ids.asset_id("AddressableAsset", F.col("asset"))).withColumn("g", ids.asset_id("Addressable", F.lit("Addressables")))
    package = rows.select(F.col("g").alias("id"), F.lit("Unity.Addressables").alias("full_name"), F.lit("Addressables").alias("label"), F.lit("Package").alias("kind"))
    nodes = package.unionByName(rows.select(F.col("a").alias("id"), F.col("asset").alias("full_name"), stem(F.col("asset")).alias("label"), F.lit("File").alias("kind")))
    code = rows.where("endswith(asset, '.cs')").withColumn("name", stem(F.col("asset"))).join(scripts.select("name", F.col("id").alias("target_id")), "name")
    edges = rows.select(F.col("g").alias("source_id"), F.col("a").alias("target_id"), F.lit("AddressableRef").alias("kind")).unionByName(code.select(F.col("a").alias("source_id"), "target_id", F.lit("References").alias("kind")))
    return nodes.dropDuplicates(["id"]), edges.distinct()


def event_fields(symbols: DataFrame) -> DataFrame:
    """Id, full_name, type_name of event fields: of UnityEvent or UnityAction types, or serialised
    ones whose type is named like an event, action or function."""
    named = lambda *words: F.coalesce(*[F.when(F.contains("type_name", F.lit(w)), True) for w in words], F.lit(False))
    kind = named("UnityEvent", "UnityAction") | F.coalesce(F.startswith("type_name", F.lit("UnityEngine.Events.")), F.lit(False))
    like = (F.col("kind") == "Field") & F.array_contains("attributes", "SerializeField") & named("Event", "Action", "Func")
    return symbols.where(F.col("kind").isin("Field", "Property") & (kind | F.coalesce(like, F.lit(False)))).select("id", "full_name", "type_name", ids.asset_id("UnityEvent", F.col("full_name")).alias("event_id"))


def event_edges(fields: DataFrame, listeners: DataFrame) -> DataFrame:
    """UnityEvent edges from events to their listeners (full_name, target_id). Fields and listeners are made distinct
    before they meet, so that a name of many fields of one event doesn't give a pair for each of them and each listener."""
    events, heard = fields.select("full_name", "event_id").distinct(), listeners.select("full_name", "target_id").distinct()
    return events.join(heard, "full_name").select(F.col("event_id").alias("source_id"), "target_id", F.lit("UnityEvent").alias("kind")).distinct()


def serialised(attributes: Column, access: Column) -> Column:
    """Whether a field is saved with its object."""
    a = F.coalesce(attributes, F.array().cast("array<string>"))
    return F.when(F.array_contains(a, "NonSerialized"), False).when(access == "Public", True).otherwise(F.array_contains(a, "SerializeField"))


def types(symbols: DataFrame) -> DataFrame:
    """Id, name, unity_kind, fields and lifecycle methods of types with a Unity base, the components that they
    require, and their menu."""
    base = F.filter(F.transform("bases", lambda b: F.try_element_at(F.create_map(*[x for k, v in BASES.items() for x in (F.lit(k), F.lit(v))]), F.regexp_extract(b, r"(\w+)$", 1))), lambda b: b.isNotNull())
    rows = symbols.where("kind = 'Type'").select("id", "name", "full_name", F.get(base, 0).alias("unity_kind"), "attributes", F.try_element_at("metadata", F.lit("RequireComponent")).alias("required"), F.try_element_at("metadata", F.lit("AddComponentMenu")).alias("component_menu")).where("unity_kind is not null")
    kept = symbols.where("kind = 'Field'").where(serialised(F.col("attributes"), F.col("access"))).groupBy("declaring_type_id").agg(F.array_sort(F.collect_list("name")).alias("serialised"))
    life = symbols.where(F.col("kind") == "Method").where(F.col("name").isin(LIFECYCLE)).groupBy("declaring_type_id").agg(F.array_sort(F.collect_list("name")).alias("lifecycle"))
    rows = rows.join(kept, F.col("id") == kept["declaring_type_id"], "left").drop("declaring_type_id").join(life, F.col("id") == life["declaring_type_id"], "left").drop("declaring_type_id")
    required = F.when(F.col("required").isNull(), F.array().cast("array<string>")).otherwise(F.split("required", ","))
    return rows.withColumn("requires_component", F.coalesce(F.array_contains("attributes", "RequireComponent"), F.lit(False))).withColumn("required", required)


def project_graph(files: DataFrame, symbols: DataFrame, guids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one Unity project: assemblies, scenes, prefabs and addressables; each id once, with what is
    found first in this order. guids has guid and name of scripts, as their .meta files say; a script is the smallest type
    of its name. Files of repositories that are no Unity projects give nothing."""
    own = files.join(is_project(files).where("unity").select("repository"), "repository", "left_semi")
    scripts = symbols.where("kind = 'Type'").groupBy("name").agg(F.min("id").alias("id"))
    known = guids.join(scripts, "name").select("guid", "id").distinct()
    parts = [assembly_graph(assemblies(own)), scene_graph(documents(own.where("file_path like '%.unity'")), known), prefab_graph(documents(own.where("file_path like '%.prefab'")), known), addressable_graph(addressables(own), scripts)]
    nodes, edges = None, None
    for i, (n, e) in enumerate(parts):
        n = n.select(*NODE, F.lit(i).alias("part"))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("part", "full_name", "label", "kind")).alias("n")).select("id", "n.full_name", "n.label", "n.kind")
    edges = edges.distinct().withColumn("id", ids.edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")))
    return nodes, edges.select("id", "source_id", "target_id", "kind", F.lit(1.0).alias("weight"))


def script_guids(files: DataFrame) -> DataFrame:
    """guid, name of scripts, from their .cs.meta files."""
    metas = files.where("file_path like '%.cs.meta'")
    return metas.select(F.regexp_extract("content", r"(?m)^guid:\s*(\w+)", 1).alias("guid"), F.regexp_extract("file_path", r"([^/\\]*?)\.cs\.meta$", 1).alias("name")).where("guid != ''")


def components_like(nodes: DataFrame, pattern: str) -> DataFrame:
    """MonoBehaviours whose label contains a text, whatever its case."""
    return nodes.where((F.col("kind") == "MonoBehaviour") & F.contains(F.lower("label"), F.lit(pattern.lower())))


def dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed, node: what requires or refers to each seed."""
    return edges.where("kind in ('Requires', 'References')").join(seeds, F.col("target_id") == F.col("seed")).select("seed", F.col("source_id").alias("node")).distinct()


def lifecycle_flow(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """type_id, place, method, callees: the lifecycle methods of each type in the order in which the engine calls them,
    and what they call."""
    order = F.array_position(F.array(*map(F.lit, LIFECYCLE)), F.col("name"))
    steps = symbols.where((F.col("kind") == "Method") & F.col("name").isin(LIFECYCLE)).select("id", F.col("declaring_type_id").alias("type_id"), F.col("name").alias("method"), order.alias("place"))
    called = edges.where("kind = 'Calls'").join(symbols.select(F.col("id").alias("target_id"), "full_name"), "target_id")
    called = called.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("full_name")).alias("callees"))
    return steps.join(called, "id", "left").select("type_id", "place", "method", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))
