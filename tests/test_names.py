import pytest
from pyspark.sql import functions as F

from codehist.functions import names as nm


def results(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


CASES = {
    nm.simplify_method_name: {
        "run/0": "run/0",
        "run/1[long]": "run/1[long]",
        "put/2[K,V]": "put/2[K,V]",
        "load/3[byte,x.io.Reader,y.Charset]": "load/3[byte,Reader,Charset]",
        "load/2[x.io.Reader[],y.Charset[][]]": "load/2[Reader[],Charset[][]]",
        "Table/4[java.util.List<java.lang.Long>,x.Row[],java.util.Map<x.Key,y.Value>,int]": "Table/4[List,Row[],Map,int]",
        "merge/1[Map<Key, Set<Row>, Row>]": "merge/1[Map]",
        "open/1[@x.Nullable Path]": "open/1[Path]",
        "open/1[ @x.Nullable @y.Owned Path ]": "open/1[Path]",
        "walk/2[Pen,SkipList<Node<T>>.Link]": "walk/2[Pen,Link]",
        "f/1[Outer$Inner]": "f/1[Inner]",
        "f/1[]": "f/1[]",
        "f/1[,]": "f/1",
        "f/1[Set<Row]": None,
        "f/1[..]": None,
        "f[": None,
        "f/1[A<B<C<D<E<F<G>>>>>>]": "f/1[A]",
    },
    nm.clean_method_name: {"put/2[K,V]": "put", "put": "put"},
    nm.clean_dollar: {"x.Outer$Inner$Core": "x.Outer.Inner.Core"},
    nm.is_anonymous_class: {
        "x.Loader.start.task.run": True,
        "x.y.z.Loader.Part": False,
        "Loader": False,
        "": None,
    },
    nm.is_java_file: {"x/Loader.Java": True, "Loader.java.orig": False, "Loader_java": False},
    nm.is_test_file: {"x/LoaderTest.java": True, "src/test/Loader.java": True, "src/test/Loader.kt": False, "src/Loader.java": False},
    nm.class_from_file: {"d:\\work\\src\\Loader.java": "Loader", "/work/src/Loader.java": "Loader"},
    nm.class_from_full_name: {".x.y.Loader": "Loader", "Loader": "Loader", "x.Loader..": "Loader"},
    nm.project_name: {"git@host.org:team/tool-kit.git": "tool-kit", "https://host.org/kit.git/": "kit"},
    nm.is_local_url: {"https://h": False, "git@h": False, "http://h": True, "/srv/h": True},
    nm.csv_escape: {'one,"two",3': '"one,""two"",3"'},
    nm.parse_thresholds: {"9, 2, 4   x": [2, 4, 9], "[9,2,4]": [2, 4, 9], "70": [70]},
    nm.dirs_only: {"/u/v.java": "/u", "v.java": None, "/v.java": "/", "u//w/x.java": "u/w", "/u/w/": "/u"},
    nm.file_name_only: {"/u/v.java": "v.java", "v.java": "v.java", "/u/w/": "w"},
    nm.last_slash_dir: {"/u": "/u/", "/u/": "/u/"},
    nm.short_summary: {"y" * 27: "y" * 20, "short": "short", None: None},
    nm.trimmed: {"\t u v \n": "u v", "\u00a0u": "\u00a0u"},
    nm.is_bug_fix: {"Fixes the build": True, "FAULTY": True, "unfixable": True, "tidy": False},
    # fixed values: level codes by type name
    nm.refactoring_level: {
        "EXTRACT_SUPERCLASS": 1, "RENAME_METHOD": 2, "RENAME_PARAMETER": 3, "CHANGE_PARAMETER_TYPE": 2,
        "RENAME_ATTRIBUTE": 4, "RENAME_PACKAGE": 5, "MERGE_OPERATION": -1,
    },
}


@pytest.mark.parametrize("fn", CASES, ids=lambda f: f.__name__)
def test_hand_cases(spark, fn):
    assert results(spark, fn, list(CASES[fn])) == list(CASES[fn].values())


def test_method_names_from_parts(spark):
    df = spark.sql("select array('Key', 'Row') as t, array(0, 2) as d")
    none = F.array().cast("array<string>")
    row = df.select(
        nm.full_method_name(F.lit("get"), F.col("t"), F.col("d")).alias("a"),
        nm.full_method_name(F.lit("get"), none, F.array().cast("array<int>")).alias("b"),
    ).first()
    assert (row.a, row.b) == ("get/2[Key,Row[][]]", "get/0")


def test_commit_url(spark):
    df = spark.sql("select 'https://code.gitea.org/u/kit.git' as u, '/srv/kit' as l")
    row = df.select(
        nm.commit_url(F.col("u"), F.lit("c1")).alias("a"),
        nm.commit_url(F.col("u"), F.lit("c1"), strict_suffix=True).alias("b"),
        nm.commit_url(F.col("l"), F.lit("c1")).alias("c"),
    ).first()
    # ".git" goes wherever it stands, also inside the host
    assert row.a == "https://codeea.org/u/kit/commit/c1"
    assert row.b == "https://code.gitea.org/u/kit/commit/c1"
    assert row.c == "@local//srv/kit/c1"


def test_cohesion(spark):
    df = spark.sql("select explode(array(0.281f, 1.0f, float('NaN'), -0.25f)) as x")
    assert [r.o for r in df.select(nm.scale_cohesion(F.col("x")).alias("o")).collect()] == [287, 1024, 0, -256]
