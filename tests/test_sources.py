"""Scans, the C# extractor, Unity readers, change logs and streams."""

import pytest
from pyspark.sql import functions as F

from symgraph.operators import graph
from symgraph.sources import csharp, unity
from symgraph.sources import files as S
from symgraph.streaming import changes as C

GAME = {
    "src/PlayerController.cs": """using System;
namespace TestGame;
/// <summary>The player.</summary>
public class PlayerController
{
    public int Health { get; set; } = 100;
    public Weapon CurrentWeapon { get; set; }

    public void Attack()
    {
        CurrentWeapon.Fire(); // fires
    }

    public void TakeDamage(int amount) { Health -= amount; }
}
""",
    "src/Weapon.cs": 'namespace TestGame\n{\n  public class Weapon\n  {\n    public int Damage { get; set; }\n    public Projectile ProjectilePrefab { get; set; }\n    public void Fire() { ProjectilePrefab.Spawn(); string s = "Spawn() {"; }\n  }\n}\n',
    "src/Projectile.cs": "namespace TestGame;\npublic class Projectile\n{\n    public float Speed { get; init; }\n    public void Spawn() => Console.WriteLine($\"spawn {Speed}\");\n}\n",
    "src/IDamageable.cs": "namespace TestGame;\npublic interface IDamageable\n{\n    void TakeDamage(int amount);\n}\n",
    "src/Enemy.cs": "namespace TestGame;\npublic class Enemy : IDamageable\n{\n    public int Health { get; private set; }\n    public void TakeDamage(int amount) { Health -= amount; }\n}\n",
}


@pytest.fixture(scope="module")
def extracted(spark):
    files = spark.createDataFrame(sorted(GAME.items()), "file_path string, content string")
    rows = csharp.extract(files).cache()
    s = csharp.symbols_of(rows).cache()
    return rows, s, csharp.resolve(rows, s).cache()


def test_extractor_golden_counts(extracted):
    rows, s, found = extracted
    assert {r.kind: r["count"] for r in s.groupBy("kind").count().collect()} == {"Namespace": 1, "Type": 5, "Property": 6, "Method": 6}
    assert csharp.nodes_of(s).count() == 17
    e = csharp.edges_of(s, found, rows)
    assert {r.kind: r["count"] for r in e.groupBy("kind").count().collect()} == {"Declares": 12, "Implements": 1, "Calls": 2}
    name = {r.id: r.full_name for r in s.collect()}
    calls = {(name[r.source_id], name[r.target_id]) for r in e.where("kind = 'Calls'").collect()}
    assert calls == {("global::TestGame.PlayerController.Attack", "global::TestGame.Weapon.Fire"), ("global::TestGame.Weapon.Fire", "global::TestGame.Projectile.Spawn")}
    seeds = s.where("name = 'Spawn'").select(F.col("id").alias("seed"))
    assert {(name[r.node].rsplit(".", 1)[1], r.depth) for r in graph.callers(e, seeds, 2).collect()} == {("Fire", 1), ("Attack", 2)}
    simple = csharp.symbols_of(rows, "simple")
    assert {r.kind: r["count"] for r in simple.groupBy("kind").count().collect()} == {"Namespace": 1, "Type": 5, "Property": 5, "Method": 4}


def test_extractor_references(extracted):
    _, s, found = extracted
    ids = {r.full_name.removeprefix("global::TestGame."): r.id for r in s.collect()}
    refs = csharp.refs_of(found)
    assert refs.where(F.col("symbol_id") == ids["Weapon.Fire"]).count() == 2  # the name and the call
    assert refs.where(F.col("symbol_id") == ids["Weapon.Fire"]).first().context == "CurrentWeapon.Fire(); // fires"
    assert {r.kind for r in refs.where(F.col("symbol_id") == ids["Enemy.Health"]).collect()} == {"Read"}


def test_extractor_on_harder_source(spark):
    text = """#nullable enable
using System.Collections.Generic;
[assembly: X]
namespace A.B
{
    [Serializable, RequireComponent(typeof(int))]
    public abstract partial class Node<T> : Base<T>, IThing where T : class
    {
        private static readonly Dictionary<string, List<int>> map = new() { ["a"] = new List<int> { 1, 2 } }, other;
        public const int Max = 3;
        public Node(int x) : base(x) { Helper(); }
        ~Node() { }
        protected internal virtual async Task<List<T>> Load<K>(ref int a, params string[] rest) { if (a > 0) { Helper(); } return null; }
        public int this[int i] => i;
        public static Node<T> operator +(Node<T> a, Node<T> b) => a;
        public event EventHandler Changed;
        public event EventHandler Custom { add { } remove { } }
        string IThing.Name => $"{{ {Max} }}" + @"\\" + \"\"\"raw " } \"\"\";
        void Helper() { }
        public enum Color { Red, Green = 2 }
        public delegate void Hook(int x);
        public record struct Point(int X, int Y);
        struct Inner { public int v; }
    }
    class Base<T> { public Base(int x) { } public virtual void Go() { } }
    class Derived : Base<int> { public override void Go() { this.Go(); } }
    interface IThing { string Name { get; } }
}
"""
    rows = csharp.extract(spark.createDataFrame([("x.cs", text), ("bad.cs", "class { ( [ < namespace"), ("none.cs", None), ("skip.txt", text)], "file_path string, content string"))
    s = csharp.symbols_of(rows)
    got = {(r.kind, r.full_name.removeprefix("global::A.B.")): r for r in s.where("file_path = 'x.cs'").collect()}
    assert {n for k, n in got if k == "Type"} == {"Node", "Node.Color", "Node.Point", "Node.Inner", "Base", "Derived", "IThing"}
    assert {n for k, n in got if k == "Method"} == {"Node.Load", "Node.Helper", "Base.Go", "Derived.Go"}
    assert {n for k, n in got if k == "Field"} == {"Node.map", "Node.other", "Node.Max", "Node.Inner.v"}
    assert {n for k, n in got if k == "Property"} == {"Node.Name", "IThing.Name"} and ("Event", "Node.Custom") in got and ("Event", "Node.Changed") not in got
    load = got["Method", "Node.Load"]
    assert load.access == "ProtectedInternal" and load.is_async and load.is_virtual and load.is_generic and load.return_type == "Task<List<T>>"
    assert [(p.name, p.type_name, p.is_ref, p.is_params) for p in load.parameters] == [("a", "int", True, False), ("rest", "string [ ]", False, True)]
    node = got["Type", "Node"]
    assert node.type_name == "Class" and node.bases == ["Base<T>", "IThing"] and node.is_abstract and node.attributes == ["Serializable", "RequireComponent"]
    assert got["Field", "Node.Max"].metadata["ConstantValue"] == "3" and got["Field", "Node.map"].is_sealed
    found = csharp.resolve(rows, s)
    name = {r.id: r.full_name.removeprefix("global::A.B.") for r in s.collect()}
    e = {(name[r.source_id], r.kind, name[r.target_id]) for r in csharp.edges_of(s, found, rows).collect()}
    assert {("Node", "Calls", "Node.Helper"), ("Node.Load", "Calls", "Node.Helper"), ("Derived", "Inherits", "Base"), ("Derived.Go", "Overrides", "Base.Go"), ("Node", "Inherits", "Base"), ("Node", "Implements", "IThing")} <= e


def linked(spark, **texts):
    rows = csharp.extract(spark.createDataFrame(sorted(texts.items()), "file_path string, content string").withColumn("file_path", F.concat("file_path", F.lit(".cs")))).cache()
    s = csharp.symbols_of(rows).cache()
    key = {r.id: r.key.removeprefix("global::") for r in s.collect()}
    return s, {(key[r.source_id], r.kind, key[r.target_id]) for r in csharp.edges_of(s, csharp.resolve(rows, s), rows).where("kind != 'Declares'").collect()}


def test_interfaces_and_overrides_at_any_depth(spark):
    _, e = linked(spark, a="interface I0 {} interface I1 : I0 {} interface I2 : I1 {} interface I3 : I2 {} interface I4 : I3 {} class C : I4 {} class D : C {} class B0 { public virtual void Go(int x) {} } class B1 : B0 {} class B2 : B1 {} class B3 : B2 {} class B4 : B3 {} class B5 : B4 { public override void Go(int y) {} }")
    assert {t for s, k, t in e if s == "C" and k == "Implements"} == {f"I{i}" for i in range(5)} == {t for s, k, t in e if s == "D" and k == "Implements"}
    assert {x for x in e if x[1] == "Overrides"} == {("B5.Go(int)", "Overrides", "B0.Go(int)")}


def test_overloads_are_symbols_of_their_own(spark):
    s, e = linked(spark, a="""namespace N; class A {
  public virtual void F() { F(1); }
  public virtual void F(int x) { F("a", Max<int, long>(x, 2), 3); }
  public void F(string s, params int[] rest) { }
  public int Max<T, U>(T a, U b) => F2(a < b, c > d);
  void F2(bool a, bool b = true) {}
}
class B : A { public override void F(int y) { this.F2(true); } public override void F() {} }""")
    assert sorted(r.key for r in s.where("name = 'F'").collect()) == [f"global::N.{x}" for x in ("A.F()", "A.F(int)", "A.F(string,int [ ])", "B.F()", "B.F(int)")]
    assert s.where("kind = 'Method'").select("id").distinct().count() == 7
    assert {x for x in e if x[1] == "Calls"} == {("N.A.F()", "Calls", "N.A.F(int)"), ("N.A.F(int)", "Calls", "N.A.F(string,int [ ])"), ("N.A.F(int)", "Calls", "N.A.Max`2(T,U)"), ("N.A.Max`2(T,U)", "Calls", "N.A.F2(bool,bool)"), ("N.B.F(int)", "Calls", "N.A.F2(bool,bool)")}
    assert {x for x in e if x[1] == "Overrides"} == {("N.B.F(int)", "Overrides", "N.A.F(int)"), ("N.B.F()", "Overrides", "N.A.F()")}


def test_bases_are_found_by_namespace(spark):
    _, e = linked(spark, a="namespace A { class Base {} class One : Base {} }", b="namespace B { class Base {} namespace In { class Two : Base {} class Three : A.Base {} } }", c="using B; namespace C; class Four : Base {}", d="namespace D; class Five : Base {} class Six : Only {}", f="namespace F; class Only {} partial class P {}", g="namespace F; partial class P : Only {}")
    assert {x for x in e if x[1] == "Inherits"} == {("A.One", "Inherits", "A.Base"), ("B.In.Two", "Inherits", "B.Base"), ("B.In.Three", "Inherits", "A.Base"), ("C.Four", "Inherits", "B.Base"), ("D.Six", "Inherits", "F.Only"), ("F.P", "Inherits", "F.Only")}


def test_a_file_that_cannot_be_read_leaves_a_row(spark):
    deep = "class A { int x = " + "(" * 5000 + "1" + ")" * 5000 + "; } " + "namespace N { " * 3000
    rows = csharp.extract(spark.createDataFrame([("deep.cs", deep), ("ok.cs", "class B {}")], "file_path string, content string"))
    assert [r.file_path for r in csharp.errors_of(rows).collect()] == ["deep.cs"] and [r.name for r in csharp.symbols_of(rows).collect()] == ["B"]


def test_scan_projects_and_changes(spark, tmp_path):
    for path, body in {**GAME, "src/TestProject.csproj": "<Project><PropertyGroup><TargetFramework>net9.0</TargetFramework></PropertyGroup></Project>", "a.sln": 'Project("{X}") = "T", "src\\TestProject.csproj", "{Y}"\nEndProject\n', "src/bin/x.cs": "x", "src/Combine.cs": "class Combine {}", "readme.md": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    found = S.scan(spark, str(tmp_path), repository="r")
    assert found.where("ext = '.cs'").count() == 6 and found.count() == 8
    assert S.solution_projects(found).first().project == "src\\TestProject.csproj"
    p = S.projects(found)
    assert p.first().target_framework == "net9.0"
    assert S.owning_project(found.where("ext = '.cs'"), p).where(F.col("project").endswith("TestProject.csproj")).count() == 6
    before = spark.createDataFrame(S.manifest(found).collect(), "file_path string, hash string")
    assert S.change_totals(S.change_set(before.limit(0), before)).first().new == 8
    (tmp_path / "src/Enemy.cs").write_text("class Enemy {}")
    (tmp_path / "src/Weapon.cs").unlink()
    kinds = {r.file_path.rsplit("/", 1)[1]: r.change_type for r in S.change_set(before, S.manifest(S.scan(spark, str(tmp_path)))).collect()}
    assert kinds == {"Enemy.cs": "Modified", "Weapon.cs": "Deleted"}


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Type", 1), ("b", "Method", 2)], "id string, kind string, n int")
    S.save(rows, str(tmp_path / "t"), "kind")
    S.save(rows.where("kind = 'Type'").withColumn("n", F.lit(9)), str(tmp_path / "t"), "kind")
    assert {(r.id, r.n) for r in S.load(spark, str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    reg = spark.createDataFrame([("/Code/App",), ("/x/lib",)], "path string")
    both = S.register_paths(reg, spark.createDataFrame([("/code/app",), ("/new",)], "path string"))
    assert {r.path for r in both.collect()} == {"/Code/App", "/x/lib", "/new"}
    assert {r.path for r in S.unregister(both, "LIB").collect()} == {"/Code/App", "/new"}


SCENE = """%YAML 1.1
--- !u!1 &10
GameObject:
  m_Name: Player
--- !u!4 &11
Transform:
  m_GameObject: {fileID: 10}
  m_Father: {fileID: 0}
--- !u!114 &12
MonoBehaviour:
  m_GameObject: {fileID: 10}
  m_Script: {fileID: 11500000, guid: abc, type: 3}
  m_Name: inner
--- !u!1 &20
GameObject:
  m_Name: Gun
--- !u!4 &21
Transform:
  m_GameObject: {fileID: 20}
  m_Father: {fileID: 11}
"""


def test_unity(spark):
    docs = unity.documents(spark.createDataFrame([("s.unity", SCENE)], "file_path string, content string"))
    scripts = spark.createDataFrame([("abc", "script-1")], "guid string, id string")
    nodes, edges = unity.scene_graph(docs, scripts)
    name = {r.id: r.label for r in nodes.collect()}
    assert set(name.values()) == {"Player", "Gun"}
    assert {(name[r.source_id], r.kind, name.get(r.target_id, r.target_id)) for r in edges.collect()} == {("Player", "Component", "script-1"), ("Gun", "ChildOf", "Player")}
    assert unity.component_totals(docs).first()[1:] == (2, 1)
    assert {r.name for r in unity.objects(unity.documents(spark.createDataFrame([("s", SCENE)], "file_path string, content string"), parity=True)).collect()} == {"inner", "Gun"}
    n, e = unity.prefab_graph(docs, scripts)
    assert n.where("kind = 'Prefab'").count() == 1 and e.where("kind = 'InstanceOf'").count() == 2
    files = spark.createDataFrame([("Assets/a.asmdef", '{"name": "Core", "references": ["Util"]}'), ("Packages/b.asmdef", '{"name": "Skip"}'), ("Assets/c.asmdef", "not json"), ("Assets/g.asset", 'm_AssetGuid: 1\nm_AssetPath: "Assets/A.cs"\nm_AssetGuid: 2\n'), ("Assets/AssetGroups/h.asset", "m_AssetGuid: 3\n"), ("ProjectSettings/p", "")], "file_path string, content string")
    asm = unity.assemblies(files)
    assert [(r.name, r.autoReferenced) for r in asm.collect()] == [("Core", True)] and unity.assembly_graph(asm)[1].first().kind == "AssemblyDep"
    a = unity.addressables(files)
    assert [(r.guid, r.asset) for r in a.collect()] == [("1", "Assets/A.cs"), ("2", "")]
    assert {r.kind for r in unity.addressable_graph(a, spark.createDataFrame([("A", "s")], "name string, id string"))[1].collect()} == {"AddressableRef", "References"}
    assert unity.is_project(files.withColumn("repository", F.lit("r"))).first().unity
    code = "public class Mob : MonoBehaviour { [SerializeField] private int hp; public int open; [NonSerialized] public int off; private int shut; public UnityEvent onHit; void Update() { } }"
    s = csharp.symbols_of(csharp.extract(spark.createDataFrame([("m.cs", code)], "file_path string, content string")))
    (t,) = unity.types(s).collect()
    assert (t.unity_kind, t.serialised, t.lifecycle) == ("MonoBehaviour", ["hp", "onHit", "open"], ["Update"])
    assert unity.types_by_text(s, spark.createDataFrame([("m.cs", code)], "file_path string, content string")).first().is_mono
    assert unity.event_fields(s).first().full_name.endswith("onHit")


def test_change_stream_applies_once(spark, tmp_path):
    m = lambda *rows: spark.createDataFrame(list(rows), "file_path string, hash string")
    log, seen = str(tmp_path / "log"), []

    def run():
        C.watch(spark, log, str(tmp_path / "c"), lambda df, n: seen.extend(sorted((r.file_path, r.change_type) for r in df.collect()))).awaitTermination()

    C.append_changes(m(("a", "1"), ("b", "1")), m(("a", "2"), ("c", "1")), log, 1)
    run()
    assert seen == [("a", "Modified"), ("b", "Deleted"), ("c", "New")]
    C.append_changes(m(("a", "2"), ("c", "1")), m(("a", "2")), log, 2)
    run()
    assert seen[3:] == [("c", "Deleted")]
    run()
    assert len(seen) == 4


def test_change_helpers(spark):
    log = spark.createDataFrame([(1, "new.cs", "Renamed", "h", "old.cs"), (2, "x.cs", "Modified", "h2", None), (3, "x.cs", "Modified", "h3", None)], C.LOG)
    rows = C.expand_renames(log)
    assert sorted((r.file_path, r.change_type) for r in rows.where("seq = 1").collect()) == [("new.cs", "New"), ("old.cs", "Deleted")]
    known = spark.createDataFrame([("x.cs", "h3")], "file_path string, hash string")
    assert {r.file_path for r in C.latest_changes(rows).collect()} == {"new.cs", "old.cs", "x.cs"} and {r.file_path for r in C.latest_changes(rows, known).collect()} == {"new.cs", "old.cs"}
    cache = spark.createDataFrame([("k", x, f"2024-01-01 00:0{i}:00") for i, x in enumerate("abc")], "cache string, key string, used string").withColumn("used", F.col("used").cast("timestamp"))
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert C.cache_left(cache, now, 2).count() == 3  # a quarter of three is none
    assert {r.key for r in C.cache_left(cache.unionByName(cache.select("cache", F.upper("key").alias("key"), "used")), now, 2).collect()} >= {"c", "C"}
    assert C.cache_left(cache, now, 10, "8 minutes 30 seconds").count() == 1


def test_extract_stream_progress_and_queue(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for name, body in GAME.items():
        (src / name.split("/")[1]).write_text(body)
    C.extract_stream(spark, f"file://{src}").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows, progress = C.observed(spark.read.parquet(out).where("row = 'declaration'"))
    assert rows.count() == 22 and progress.get["rows"] == 22  # each file declares the namespace
    assert S.has_data(spark, out) and not S.has_data(spark, str(tmp_path / "none"))
    q = C.queued(spark.createDataFrame([("a", 0, 5), ("b", 1, 9), ("a", 1, 7), ("c", 0, 1)], "path string, priority int, seq long"))
    assert sorted((r.path, r.priority, r.seq, r.place) for r in q.collect()) == [("a", 1, 5, 1), ("b", 1, 9, 2), ("c", 0, 1, 1)]


def test_design_edges(spark, extracted):
    rows, s, found = extracted
    name = {r.id: r.full_name.removeprefix("global::TestGame") for r in s.collect()}
    got = {(name[r.source_id], r.kind, name[r.target_id]) for r in csharp.design_edges(s, csharp.edges_of(s, found, rows)).collect()}
    assert ("", "Contains", ".Enemy") in got and (".Enemy.TakeDamage", "Implements", ".IDamageable.TakeDamage") in got


UNITY = {
    "p/Assets/Player.cs": 'using UnityEngine;\nnamespace G;\n[RequireComponent(typeof(Body)), AddComponentMenu("Game/Player")]\npublic class Player : MonoBehaviour {\n  [SerializeField] int hp;\n  void Update() { Move(); }\n  void Awake() { }\n  void Move() { }\n}\n',
    "p/Assets/Player.cs.meta": "fileFormatVersion: 2\nguid: abc123\n",
    "p/Assets/Game.asmdef": '{"name": "Game", "references": ["Core"]}',
    "p/Assets/Main.unity": "%YAML 1.1\n--- !u!1 &10\nGameObject:\n  m_Name: Hero\n--- !u!4 &11\nTransform:\n  m_GameObject: {fileID: 10}\n  m_Father: {fileID: 0}\n--- !u!114 &12\nMonoBehaviour:\n  m_GameObject: {fileID: 10}\n  m_Script: {fileID: 1, guid: abc123}\n",
    "p/Assets/Hero.prefab": "--- !u!1 &20\nGameObject:\n  m_Name: Hero\n",
    "p/Assets/Group.asset": "m_AssetGuid: aa\nm_AssetPath: Assets/Player.cs\n",
    "p/ProjectSettings/x.asset": "",
}


def test_one_graph_of_a_unity_project(spark):
    files = spark.createDataFrame([("game", p, t) for p, t in UNITY.items()] + [("plain", "src/Main.unity", UNITY["p/Assets/Main.unity"])], "repository string, file_path string, content string")
    rows = csharp.extract(files)
    s = csharp.symbols_of(rows).cache()
    n, e = unity.project_graph(files, s, unity.script_guids(files))
    got = {r.id: r for r in n.collect()}
    assert sorted((r.kind, r.label) for r in got.values()) == [("Assembly", "Game"), ("File", "Player"), ("GameObject", "Hero"), ("GameObject", "Hero"), ("Package", "Addressables"), ("Prefab", "Hero")]
    script = s.where("name = 'Player'").first().id
    assert {(r.kind, r.target_id == script) for r in e.collect()} == {("AssemblyDep", False), ("Component", True), ("InstanceOf", False), ("AddressableRef", False), ("References", True)}
    assert e.count() == e.select("id").distinct().count() == 5
    (t,) = unity.types(s).collect()
    assert (t.required, t.component_menu, t.serialised, t.lifecycle) == (["Body"], "Game/Player", ["hp"], ["Awake", "Update"])
    flow = unity.lifecycle_flow(s, csharp.edges_of(s, csharp.resolve(rows, s), rows)).orderBy("place").collect()
    assert [(r.method, [c.rsplit(".", 1)[1] for c in r.callees]) for r in flow] == [("Awake", []), ("Update", ["Move"])]
    nodes = spark.createDataFrame([("a", "PlayerController", "MonoBehaviour"), ("b", "Body", "Class")], "id string, label string, kind string")
    assert [r.id for r in unity.components_like(nodes, "CONTROL").collect()] == ["a"]
    edges = spark.createDataFrame([("a", "b", "Requires"), ("a", "b", "References"), ("c", "b", "Calls")], "source_id string, target_id string, kind string")
    assert [(r.seed, r.node) for r in unity.dependents(edges, spark.createDataFrame([("b",)], "seed string")).collect()] == [("b", "a")]


TYPED = {
    "lib": """namespace O { public class A { public void M() { } public void K() { } public B Made; public A Self() => this; } public class B { public void M() { } public A[] All() => null; public System.Collections.Generic.List<A> Some { get; set; } }
public class Up2 { public void Deep() { } public virtual void Both() { } } public class Up1 : Up2 { } public class Down : Up1 { public void Use() { Deep(); base.Both(); this.Deep(); } public override void Both() { } }
public static class Ext { public static void Grow(this A a, int by) { } } }""",
    "use": """using O; using System.Threading.Tasks;
namespace Q { public class C { public A held; public static A One() => new A(); A Make() => held; B Other(int n) => null; async Task<A> Later() => null;
 void Parameter(A a) { a.M(); } void Local() { var x = new A(); x.M(); } void Result() { Make().M(); } void Declared() { B b = Other(1); b.M(); }
 void Chain(B b) { Make().Self().Self().Made.M(); b.All()[0].M(); b.Some[1].K(); } void Each(B b) { foreach (var a in b.All()) { a.M(); } foreach (A a in b.Some) a.K(); }
 async void Awaited() { var x = await Later(); x.M(); (await Later()).K(); } void Cast(object o) { ((A)o).M(); (o as B).M(); if (o is A a) { a.K(); } }
 void Static() { C.One().M(); Q.C.One().K(); } void Shadow(string held) { held.M(); } void After() { { var held = new B(); held.M(); } held.M(); } void Own() { this.held.M(); held?.K(); held!.M(); }
 void Extended(A a) { a.Grow(1); } void Lambda() { Call(held => held.M()); } C(B made) { made.M(); } void New() { new A().M(); new O.B().M(); } void Call(object o) { } } }
namespace P { public class A { public void M() { } } public class E : A { void Go() { K(); M(); } } }""",
}


def test_calls_go_to_the_type_of_their_receiver(spark):
    _, e = linked(spark, **TYPED)
    calls = {}
    for s, k, t in e:
        if k == "Calls":
            calls.setdefault(s.split("(")[0].removeprefix("Q.C."), set()).add(t.removeprefix("O.").removesuffix("()"))
    want = {
        "Parameter": {"A.M"}, "Local": {"A.M"}, "Result": {"Q.C.Make", "A.M"}, "Declared": {"Q.C.Other(int)", "B.M"}, "Chain": {"Q.C.Make", "A.Self", "B.M", "B.All", "A.M", "A.K"}, "Each": {"B.All", "A.M", "A.K"},
        "Awaited": {"Q.C.Later", "A.M", "A.K"}, "Cast": {"A.M", "B.M", "A.K"}, "Static": {"Q.C.One", "A.M", "A.K"}, "After": {"B.M", "A.M"}, "Own": {"A.M", "A.K"}, "Extended": {"Ext.Grow(A,int)"}, "Lambda": {"Q.C.Call(object)"},
        "Q.C": {"B.M"}, "New": {"A.M", "B.M"}, "Make": set(), "O.Down.Use": {"Up2.Deep", "Up2.Both"}, "P.E.Go": {"P.A.M"},
    }
    assert {k: v for k, v in calls.items()} == {k: {x.replace("Ext.Grow(A,int)", "Ext.Grow(A,int)") for x in v} for k, v in want.items() if v}


def test_texts_are_extracted_once_whatever_their_repository(spark, tmp_path, monkeypatch):
    store = "shared_rows"
    spark.sql(f"drop table if exists {store}")
    one = spark.createDataFrame([("a.cs", "class A { void M() { } }"), ("b.cs", "class A { void M() { } }"), ("c.cs", ""), ("d.txt", "class T { }"), ("e.cs", None)], "file_path string, content string")
    got = csharp.extract_shared(one, store, 4)
    want = csharp.extract(one)
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(got) == key(want) and got.columns == want.columns
    two = one.where("file_path != 'b.cs'").withColumn("file_path", F.concat(F.lit("other/"), "file_path"))
    texts = spark.table(store).select("content_hash").distinct().count()
    real = csharp.extract
    monkeypatch.setattr(csharp, "extract", lambda df: (_ for _ in ()).throw(AssertionError("a known text is read again")))
    again = csharp.extract_shared(two, store, 4)
    monkeypatch.setattr(csharp, "extract", real)
    assert key(again) == key(csharp.extract(two)) and spark.table(store).select("content_hash").distinct().count() == texts == 2
    plan = spark.table(store).select("content_hash", "name").join(spark.table(store).groupBy("content_hash").count(), "content_hash").hint("merge")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text
    spark.sql(f"drop table {store}")


def test_fields_and_listeners_of_an_event_are_distinct_before_they_meet(spark):
    fields = spark.range(300).selectExpr("'a' as full_name", "'e' as event_id")
    heard = spark.range(300).selectExpr("'a' as full_name", "id div 3 as target_id")
    found = unity.event_edges(fields, heard)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert below.count("Aggregate") == 2  # else 90,000 pairs for 100 edges
    assert sorted(r.target_id for r in found.collect()) == list(range(100))


def test_long_lines_leave_a_file_in_parts(spark):
    """A line of many mentions is held once, leaves the reader a few megabytes at a time, and isn't made where only calls or
    declarations are asked for (F3, F4)."""
    text = "class A { void M() { " + "a.F(); " * 6_000 + "} void F() { }\nint n; }"
    parts = list(csharp.read_parts("a.cs", text, csharp.arrow_schema()))
    assert max(p.nbytes for p in parts) < 3 * csharp.CHARACTERS_AT_ONCE and sum(p.num_rows for p in parts) == 12_004
    assert [r for p in parts for r in p.to_pylist() if r["row"] == "mention"][-1]["context"] == text.split("\n")[0].strip()
    calls, declared = (sum(p.num_rows for p in csharp.read_parts("a.cs", text, csharp.arrow_schema(), w)) for w in ("calls", "declarations"))
    assert (calls, declared) == (6_004, 4)
    files = spark.createDataFrame([("a.cs", text)], "file_path string, content string")
    rows = csharp.extract(files, "calls").cache()
    s = csharp.symbols_of(rows)
    assert csharp.resolve(rows, s, places=False).collect() == csharp.resolve(csharp.extract(files), s).where("kind = 'Call'").select("target_id", "source_id", "kind").distinct().collect() != []
