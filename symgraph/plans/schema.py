"""Canonical tables, as DDL, and enumerations."""

from __future__ import annotations

# Names in ordinal order; edge ids hash the ordinal.
SYMBOL_KINDS = "Unknown Type Method Property Field Event Parameter Namespace Local".split()
TYPE_KINDS = "Unknown Class Struct Interface Enum Record Delegate".split()
METHOD_KINDS = "Regular Constructor Destructor Static Extension Operator Conversion".split()
ACCESS = "NotApplicable Public Internal Protected Private ProtectedInternal PrivateProtected".split()
REFERENCE_KINDS = "Unknown Read Write Call Type Attribute Base Constraint".split()
DEPENDENCY_KINDS = "ProjectReference PackageReference AssemblyReference".split()
CHUNK_TYPES = "File Type Method Semantic GraphContext".split()
STRATEGIES = "SymbolOnly GraphOnly VectorOnly SymbolGraph Hybrid GraphRAG".split()
NODE_KINDS = "Unknown Repository Project Namespace Class Struct Interface Enum Record Method Property Field Event File Assembly Package MonoBehaviour ScriptableObject Editor GameObject Prefab Component".split()
EDGE_KINDS = (
    "Unknown Contains Calls Uses References Inherits Implements Declares DependsOn Overrides Reads Writes Requires Attribute Returns Parameter FieldType PropertyType EventHandler "
    "ImplicitlyImplements ChildOf InstanceOf AddressableRef UnityEvent Coroutine AssemblyDep Component"
).split()

PARAMETER = "struct<name:string,type_name:string,has_default:boolean,default_value:string,is_params:boolean,is_this:boolean,is_ref:boolean,is_out:boolean,is_in:boolean>"
FLAGS = ("is_static", "is_abstract", "is_sealed", "is_virtual", "is_override", "is_async", "is_generic")

SYMBOLS = (
    "id string, repository string, name string, full_name string, kind string, type_name string, container_id string, declaring_type_id string, file_path string, start_line int, end_line int, "
    "is_definition boolean, access string, " + ", ".join(f"{f} boolean" for f in FLAGS) + f", return_type string, parameters array<{PARAMETER}>, metadata map<string,string>, xml_doc string, code_hash string, updated_at timestamp"
)
REFS = "repository string, symbol_id string, source_symbol_id string, file_path string, line int, column int, kind string, context string"
NODES = "id string, repository string, full_name string, label string, kind string, metadata map<string,string>"
EDGES = "id string, repository string, source_id string, target_id string, kind string, weight double"
FILES = "repository string, file_path string, ext string, content string, size long, hash string, line_count int"
CHANGES = "file_path string, change_type string, hash string"
VECTORS = "collection string, id string, vector array<float>, payload map<string,string>"
