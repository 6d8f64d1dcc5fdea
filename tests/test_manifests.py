from plumbline.operators import manifests as op

FILES = [
    ("n1", "package.json", '{"dependencies": {"b": "1", "a": "1"}, "devDependencies": {"a": "2"}}', "npm", ["a", "a", "b"]),
    ("n2", "package.json", "{broken", None, None),
    ("n3", "package.json", '{"dependencies": ["a"]}', None, None),
    ("n4", "package.json", "{}", None, None),
    ("n6", "package.json", '{"dependencies": null, "devDependencies": {"x": "1"}}', None, None),
    ("n7", "package.json", '["dependencies"]', None, None),
    ("n5", "package.json", '{"devDependencies": {"x": "1"}}', "npm", ["x"]),
    ("p1", "requirements.txt", "# all\n\nflask>=2\r\npkg == 1 # why\nodd!=1\n  spaced~=1\nplain", "pip", ["flask", "odd!", "pkg ", "plain", "spaced"]),
    ("m1", "pom.xml", "<artifactId>b</artifactId><x/><artifactId>a</artifactId>\n<artifactId>b</artifactId><artifactId>no\n</artifactId>", "maven", ["a", "b"]),
    ("c1", "My.csproj", '<PackageReference Include="Z"/>\n<PackageReference\n Include="Y" Version="1"/>', "nuget", ["Y", "Z"]),
    ("x1", "other.txt", "flask", None, None),
]


def test_dependencies(spark, rows):
    df = spark.createDataFrame([f[:3] for f in FILES], "root string, filename string, content string")
    got = {r["root"]: (r["kind"], r["deps"]) for r in op.dependencies(df).collect()}
    assert got == {root: (kind, deps) for root, _, _, kind, deps in FILES if kind}


def test_projects_sharing_a_list(spark, rows):
    df = spark.createDataFrame([("a", "requirements.txt", "x\ny"), ("b", "requirements.txt", "y\nx"), ("c", "requirements.txt", "x"),
                                ("d", "package.json", '{"dependencies": {"x": "1", "y": "1"}}'), ("e", "requirements.txt", "")],
                               "root string, filename string, content string")
    assert rows(op.deps_clusters(df)) == [("pip:x,y", "a", 2), ("pip:x,y", "b", 2)]
