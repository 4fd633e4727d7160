"""Table schemas and the dimension of label types."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# The class metrics of a training row, in output order.
CLASS_METRICS = [
    "classCbo",
    "classWmc",
    "classRfc",
    "classLcom",
    "classTCC",
    "classLCC",
    "classNumberOfMethods",
    "classNumberOfStaticMethods",
    "classNumberOfPublicMethods",
    "classNumberOfPrivateMethods",
    "classNumberOfProtectedMethods",
    "classNumberOfDefaultMethods",
    "classNumberOfVisibleMethods",
    "classNumberOfAbstractMethods",
    "classNumberOfFinalMethods",
    "classNumberOfSynchronizedMethods",
    "classNumberOfFields",
    "classNumberOfStaticFields",
    "classNumberOfPublicFields",
    "classNumberOfPrivateFields",
    "classNumberOfProtectedFields",
    "classNumberOfDefaultFields",
    "classNumberOfFinalFields",
    "classNumberOfSynchronizedFields",
    "classNosi",
    "classLoc",
    "classReturnQty",
    "classLoopQty",
    "classComparisonsQty",
    "classTryCatchQty",
    "classParenthesizedExpsQty",
    "classStringLiteralsQty",
    "classNumbersQty",
    "classAssignmentsQty",
    "classMathOperationsQty",
    "classVariablesQty",
    "classMaxNestedBlocks",
    "classAnonymousClassesQty",
    "classSubClassesQty",
    "classLambdasQty",
    "classUniqueWordsQty",
]
# Cohesion arrives as a ratio and is stored as a scaled int.
COHESION = ["classTCC", "classLCC"]

# The method metrics of a training row, in output order.
METHOD_METRICS = [
    "methodCbo",
    "methodWmc",
    "methodRfc",
    "methodLoc",
    "methodReturnQty",
    "methodVariablesQty",
    "methodParametersQty",
    "methodInvocationsQty",
    "methodInvocationsLocalQty",
    "methodInvocationsIndirectLocalQty",
    "methodLoopQty",
    "methodComparisonsQty",
    "methodTryCatchQty",
    "methodParenthesizedExpsQty",
    "methodStringLiteralsQty",
    "methodNumbersQty",
    "methodAssignmentsQty",
    "methodMathOperationsQty",
    "methodMaxNestedBlocks",
    "methodAnonymousClassesQty",
    "methodSubClassesQty",
    "methodLambdasQty",
    "methodUniqueWordsQty",
]

COMMITS = _struct(
    project=S,
    commit_id=S,
    parents=T.ArrayType(S),
    author=S,
    author_ts=T.TimestampType(),
    author_tz=S,
    message=S,
    walk_pos=L,
)

FILE_CHANGES = _struct(
    project=S, commit_id=S, entry_pos=I, change_type=S, old_path=S, new_path=S
)

EDITS = _struct(project=S, commit_id=S, entry_pos=I, edit_pos=I, len_a=I, len_b=I)

FILE_CLASS = T.StructType([T.StructField("file", S), T.StructField("class", S)])

REFACTORINGS = _struct(
    project=S,
    commit_id=S,
    ref_pos=I,
    type=S,
    display_name=S,
    summary=S,
    before=T.ArrayType(FILE_CLASS),
    after=T.ArrayType(FILE_CLASS),
    method_full_name=S,
    element_name=S,
)

CK_METHOD = T.StructType(
    [T.StructField("name", S), T.StructField("start_line", I)]
    + [T.StructField(m, I) for m in METHOD_METRICS]
    + [
        T.StructField("variables", T.MapType(S, I)),
        T.StructField("fields", T.MapType(S, I)),
    ]
)

CK_CLASSES = T.StructType(
    [T.StructField(n, S) for n in ("project", "commit_id", "file", "class", "type")]
    + [T.StructField(m, T.FloatType() if m in COHESION else I) for m in CLASS_METRICS]
    + [T.StructField("methods", T.ArrayType(CK_METHOD))]
)

SOURCE_FILES = _struct(project=S, commit_id=S, path=S, text=S)

# The studied label types by level, and their codes.
LEVEL_CODES = {"CLASS": 1, "METHOD": 2, "VARIABLE": 3, "ATTRIBUTE": 4, "OTHER": 5}
LABEL_TYPES = {
    "CLASS": [
        "EXTRACT_INTERFACE",
        "MOVE_CLASS",
        "RENAME_CLASS",
        "EXTRACT_CLASS",
        "EXTRACT_SUBCLASS",
        "EXTRACT_SUPERCLASS",
        "MOVE_RENAME_CLASS",
        "CONVERT_ANONYMOUS_CLASS_TO_TYPE",
        "INTRODUCE_POLYMORPHISM",
    ],
    "METHOD": [
        "CHANGE_RETURN_TYPE",
        "RENAME_METHOD",
        "MOVE_OPERATION",
        "EXTRACT_AND_MOVE_OPERATION",
        "EXTRACT_OPERATION",
        "PULL_UP_OPERATION",
        "PUSH_DOWN_OPERATION",
        "INLINE_OPERATION",
        "MOVE_AND_INLINE_OPERATION",
        "MOVE_AND_RENAME_OPERATION",
        "CHANGE_PARAMETER_TYPE",
        "SPLIT_PARAMETER",
        "MERGE_PARAMETER",
    ],
    "VARIABLE": [
        "CHANGE_VARIABLE_TYPE",
        "SPLIT_VARIABLE",
        "EXTRACT_VARIABLE",
        "INLINE_VARIABLE",
        "PARAMETERIZE_VARIABLE",
        "RENAME_VARIABLE",
        "REPLACE_VARIABLE_WITH_ATTRIBUTE",
        "RENAME_PARAMETER",
        "MERGE_VARIABLE",
    ],
    "ATTRIBUTE": [
        "MOVE_ATTRIBUTE",
        "PULL_UP_ATTRIBUTE",
        "MOVE_RENAME_ATTRIBUTE",
        "PUSH_DOWN_ATTRIBUTE",
        "REPLACE_ATTRIBUTE",
        "RENAME_ATTRIBUTE",
        "EXTRACT_ATTRIBUTE",
        "CHANGE_ATTRIBUTE_TYPE",
    ],
    "OTHER": ["MOVE_SOURCE_FOLDER", "RENAME_PACKAGE"],
}
# Types that rename a class, and types that concern all classes.
CLASS_RENAMES = ["MOVE_RENAME_CLASS", "RENAME_CLASS", "MOVE_CLASS"]
ALL_CLASSES = ["EXTRACT_SUPERCLASS", "EXTRACT_INTERFACE", "MOVE_SOURCE_FOLDER", "RENAME_PACKAGE"]
# The types an older detector knew; an optional filter.
LEGACY_TYPES = [
    "EXTRACT_OPERATION",
    "RENAME_CLASS",
    "MOVE_ATTRIBUTE",
    "RENAME_METHOD",
    "INLINE_OPERATION",
    "MOVE_OPERATION",
    "PULL_UP_OPERATION",
    "MOVE_CLASS",
    "MOVE_RENAME_CLASS",
    "MOVE_SOURCE_FOLDER",
    "PULL_UP_ATTRIBUTE",
    "PUSH_DOWN_ATTRIBUTE",
    "PUSH_DOWN_OPERATION",
    "EXTRACT_INTERFACE",
    "EXTRACT_SUPERCLASS",
    "MERGE_OPERATION",
    "EXTRACT_AND_MOVE_OPERATION",
    "CONVERT_ANONYMOUS_CLASS_TO_TYPE",
    "INTRODUCE_POLYMORPHISM",
    "RENAME_PACKAGE",
]

NO_FILE = "/dev/null"
DEFAULT_THRESHOLDS = (20, 50)

