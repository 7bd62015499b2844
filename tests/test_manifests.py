"""Project files and the datasets that classes and schemas describe."""

from dataspoor.operators import datasets as D
from dataspoor.sources import manifests as M
from dataspoor.sources import python

PRISMA = """
model User {
  id        Int     @id
  email     String  @unique @map("e_mail")
  state     String?
  posts     Post[]
  @@map("users")
}
enum Role { A B }
"""
COMPOSE = """
services:
  web:
    build: ./web
    environment:
      - API__URL=http://api:80
    depends_on:
      - api
  api:
    image: "x/api:1"
volumes:
  data:
"""


def test_readers():
    assert ("dependency", "express", "^4") in M.read("a/package.json", '{"name": "x", "dependencies": {"express": "^4"}, "workspaces": ["p/*"]}')
    assert M.read("tsconfig.base.json", '{ // c\n "extends": "../t.json", "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]},},}') == [("extends", "../t.json", ""), ("base_url", "", "."), ("alias", "@/*", "src/*")]
    assert ("dependency", "flask", "Flask>=2") in M.read("pyproject.toml", '[project]\nname = "p"\ndependencies = ["Flask>=2"]')
    assert M.read("requirements-dev.txt", "-r x\nDjango==4 # c\n\n") == [("dependency", "django", "Django==4")]
    cs = M.read("src/A.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup><ProjectReference Include="..\\B\\B.csproj"/></ItemGroup></Project>')
    assert cs == [("sdk", "", "Microsoft.NET.Sdk.Web"), ("ProjectReference", "../B/B.csproj", "")]
    assert M.read("s.prisma", PRISMA)[:3] == [("model", "User", "users"), ("field", "User.id", "Int @id"), ("field", "User.e_mail", 'String @unique @map("e_mail")')]
    assert M.read("docker-compose.yml", COMPOSE) == [("service", "web", ""), ("context", "web", "./web"), ("environment", "web.API__URL", "http://api:80"), ("depends_on", "web", "api"), ("service", "api", ""), ("image", "api", "x/api:1")]
    assert M.read("package.json", "{")[0][0] == "unreadable" and M.read("a.csproj", "<a>")[0][0] == "unreadable"
    assert M.read("readme.md", "x") == []


def test_datasets(spark):
    files = spark.createDataFrame([("r", "db/s.prisma", PRISMA), ("r", "x.txt", "")], "repo string, path string, text string")
    got = {r.field: (r.collection, r.category) for r in D.datasets(D.schema_fields(M.manifest_rows(files))).collect()}
    assert got["state"] == ("users", None) and got["posts"] == ("users", None)
    text = "from django.db import models\nclass Person(models.Model):\n    email = models.CharField()\n    state = models.CharField()\n    city = models.TextField()\n    size = 3\n"
    ir = python.lower_files(spark.createDataFrame([("r", "m.py", text)], "repo string, path string, text string"))
    mine = {r.field: r.category for r in D.datasets(D.class_fields(ir)).collect()}
    assert mine == {"email": "user.contact.email", "state": "user.contact.address.state", "city": "user.contact.address.city"}
