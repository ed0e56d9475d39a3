"""Names, ordinals and table shapes that the whole engine agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: kinds of dependency in order of their ordinals
DEPENDENCY_TYPES = (
    "Inheritance Interface Field Property Method Constructor Parameter ReturnType LocalVariable GenericArgument Attribute UsingDirective "
    "NamespaceReference StaticReference CastOperation TypeOfExpression IsExpression AsExpression NewExpression ArrayCreation Delegate Event "
    "IndexerAccess ExtensionMethod AnonymousType Lambda LinqExpression MethodCall FieldAccess PropertyAccess LocalVariableType"
).split()
PROFILES = "Balanced HighQualityCore HighRiskCoupling TestingChallenge BusinessCritical WeakConnection".split()
LAYERS = "Presentation Application Domain Infrastructure Data Test Configuration Unknown".split()
SEVERITIES = ("Low", "Medium", "High", "Critical")
STEP_TYPES = ("System", "Task", "Planning", "Action", "Final")

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        *[T.StructField(c, T.StringType()) for c in ("name", "namespace", "project", "file_path")],
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        *[T.StructField(c, T.BooleanType()) for c in ("is_abstract", "is_static", "is_sealed")],
        T.StructField("documentation", T.StringType()),
        T.StructField("source_code", T.StringType()),
        T.StructField("usings", T.ArrayType(T.StringType())),
        T.StructField("node_seq", T.LongType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("edge_seq", T.LongType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("dep_type", T.StringType()),
        T.StructField("dep_ord", T.IntegerType()),
        T.StructField("member_name", T.StringType()),
    ]
)
PARAMETER = "struct<name: string, type: string, isNullable: boolean, defaultValue: string>"
MEMBER = f"struct<kind: string, name: string, type: string, returnType: string, modifiers: array<string>, attributes: array<string>, parameters: array<{PARAMETER}>, hasGetter: boolean, hasSetter: boolean>"
ELEMENT = f"struct<name: string, modifiers: array<string>, baseTypes: array<string>, attributes: array<string>, members: array<{MEMBER}>, values: array<string>>"
#: The arrays of an AST document and the tag of the rows that come from each.
AST_ARRAYS = {"classes": "class", "interfaces": "interface", "enums": "enum", "records": "record", "structs": "struct"}
AST_DOCUMENT = "type string, namespace string, usings array<string>, " + ", ".join(f"{a} array<{ELEMENT}>" for a in AST_ARRAYS)
DOMAIN_DOCUMENT = "domains array<struct<name: string, reasoning: string>>"
LEVEL = "struct<content: string, processed_at: timestamp, duration_s: double, is_success: boolean, error_message: string>"
FILE_ENTRIES = f"path_key string, file_path string, file_hash string, processed_at timestamp, last_modified timestamp, file_size long, status string, level_data map<string, {LEVEL}>"
