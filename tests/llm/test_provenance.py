import pytest
from pyspark.sql import functions as F

from docloom.llm import provenance as P

PATHS = {
    "go.sum": True, "x/package-lock.json": True, "web/dist/a.js.map": True, "a/b.min.js": True, "a/b.pb.go": True, "a/zz_generated.b.go": True, "Vendor/x/y.go": True, " ./third_party/x/a.py ": True, "app\\node_modules\\x\\a.js": True,
    "static/x.bundle.js": True, "public/x-1abe8196.js": True, "target/generated-sources/x/A.java": True, "a/b_pb2.py": True, "a/b.g.cs": True,
    "src/distribution/a.go": False, "src/external_ids/a.py": False, "pkg/vendors/a.go": False, "src/generators/a.py": False, "src/buildinfo/a.go": False, "lib/vendor_list_a.sql": False, "core/lockfile_a.go": False, "src/minify/a.js": False,
    "@source-files": False, "": False, None: False, "README.md": False, "package.json": False, "go.mod": False,
}


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    assert {r.path: r.hit for r in df.select("path", P.by_path(F.col("path")).alias("hit")).collect()} == PATHS


CODE = "import os\n\ndef f(a):\n    return a\n" * 6


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// Code generated by x-gen v1.2. DO NOT EDIT.\npackage a\n", "notice"), ("### FILE: a.py\n# Copyright of x.\n#\n# Machine made by x; regenerate instead of editing.\n" + CODE, "notice"), (CODE + "\n# Autogenerated with x 3.0 - do not modify\n", "notice"),
        (CODE + "\n# @generated by x from y.schema\n" + "\n" * 5000, "notice"), ("\n" * 300 + "# Code generated by x. DO NOT EDIT.\n" + CODE, "notice"),
        ("# License text.\n" * 90 + "# Code generated by x. DO NOT EDIT.\n" + CODE, "notice"), ("// " + "x " * 400 + "do not edit\n" + CODE, "notice"),
        ("/*\n * @generated by x from y.schema\n */\nclass A {}\n", "notice"), ("# unlike the generated client, this module is written and edited by hand\n" + CODE, None), ("# auto-generated ids are allowed below\n" + CODE, None),
        (CODE + "x = 1\n# writes the 'do not edit' banner into every output file\n" + CODE, None), (CODE, None), (None, None), ("", None), ("\n\n", None),
        ("function qn(q,n){return q.g(n,17)}var n={r:517,r:\"s\"};" * 60, "minified"), ("X = [\n" + "    0xdeed, 0xd4a8, 0x51d8,\n" * 40 + "]\n", "data"), ("INSERT INTO a VALUES (1, 'x', 2);\n" * 40, "data"),
        ("export const a = '" + "aB3/" * 500 + "';\n", "data"), ("module.exports = [\n" + "[-69.405527,-170.983573],\n" * 40 + "];\n", "data"), ("# a long line " + "word " * 200 + "\n" + CODE, None),
    ],
)
def test_text(text, want):
    assert P.reason(text) == want


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "// @generated\nx", None), (3, "// @generated\nx", "x"), (4, CODE, "x")], "change_id long, after string, reason string")
    assert [(r.change_id, r.reason) for r in P.by_text(df, "change_id", "after").collect()] == [(3, "notice")] * 2
    assert P.by_text(df.limit(0), "change_id", "after").count() == 0


@pytest.mark.parametrize(
    "head",
    [
        "# This file is automatically generated and must not be edited by hand", "// Code generated by x: generated client for y. DO NOT EDIT.", "# auto-generated; do not edit this banner", "// This file was\n// generated by x.", "# Generated types. Do not\n# edit.",
    ],
)
def test_notices_that_nothing_denies(head):
    assert P.reason(head + "\nx = call(1)\n") == "notice"


HEADERS = [
    "// Code generated by protoc. DO NOT EDIT. This is the generated client.", "// The banner of this file. Code generated by mockery; DO NOT EDIT.", "# This file was automatically @generated by a package manager and is not intended for manual editing.", "# Este arquivo foi gerado automaticamente. Não edite.",
    "// このファイルは自動生成されました。編集しないでください。", "// <auto-generated>", "// This code was generated by a tool.\n//     Changes to this file may cause incorrect behavior and will be lost if the code is regenerated.", "/* Generated from schema.graphql - do not modify */", "# Generated by Django 4.2 on 2024-01-01 10:00",
    "// Note: this file is auto-generated by the build", "# AUTOGENERATED FILE. Never edit by hand.", "-- Diese Datei wurde automatisch erzeugt, bitte nicht von Hand ändern", "# Ce fichier a été généré par x", "// File generated with x; manual edits will be overwritten", "# Copied from https://x.invalid/a/b.py", "// Файл автоматически сгенерирован, не редактировать",
    "<!-- do not edit this file directly -->", "; DON'T TOUCH! machine-generated",
]
OTHERS = [
    "# Do not edit the generated client by hand; change the schema instead.", "// Helpers for code that is generated by the compiler", "# Tests that the generated files carry the right header", "// prints \"Code generated by x. DO NOT EDIT.\" into each file", "# Never change these limits without asking the owner", "# Do not modify a running job", "// reads generated reports from the disk",
    "# the do not edit banner is checked below", "// Generates the client from the schema", "# Values are imported from the environment", "# Nicht vergessen: Tests laufen lassen", "# auto-generated names are fine here, this module is not", "// Users may not edit pages that others lock",
]


@pytest.mark.parametrize("head", HEADERS)
def test_headers_of_tools(head):
    assert P.reason(head + "\n\nx = call(1)\n") == "notice"


@pytest.mark.parametrize("head", OTHERS)
def test_comments_on_other_files(head):
    assert P.reason(head + "\n\nx = call(1)\n") is None
