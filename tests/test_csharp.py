"""C# declarations: what a first pass reads, and what can't be read is a row and not silence."""

from pyspark.sql import functions as F

from dataspoor.operators import datasets
from dataspoor.sources import catalogue, csharp
from dataspoor.sources import files as S

CODE = '''
using System;
using Alias = Microsoft.EntityFrameworkCore.DbContext;
namespace Shop.Data
{
    /* class Hidden { } */
    [Table("users"), Obsolete]
    public partial class User<T> : Entity<int, T>, IHas where T : class
    {
        [Key] public int Id { get; set; } = 3;
        private readonly List<Dictionary<string, int>> _x = new() { {"a", 1} };
        public string Email => "a;{" + x;
        public User(string email, [FromBody] int? n = 5) : base(email) { if (a) { b(); } }
        public async Task<List<User>> Load<K>(this K k, params string[] xs) where K : new() => await f(k);
        public string this[int i] { get => ""; }
        enum Kind { A, B = 2 }
        class Inner { int y; }
        const string S = @"x""y}";
        string raw = """ a " } """;
    }
}
namespace Other { public record Point(int X, string Name); }
'''


def test_declarations():
    rows = csharp.declare("", "a.cs", CODE)
    got = {(r["kind"], r["fqn"], r["type"]) for r in rows}
    at = "Shop.Data.User"
    assert got == {
        ("using", "System", None), ("using", "Microsoft.EntityFrameworkCore.DbContext", "Alias"), ("class", at, "<T>"), ("property", f"{at}.Id", "int"), ("field", f"{at}._x", "List<Dictionary<string,int>>"),
        ("property", f"{at}.Email", "string"), ("method", f"{at}.User", None), ("method", f"{at}.Load", "Task<List<User>>"), ("property", f"{at}.this[]", "string"), ("enum", f"{at}.Kind", None), ("class", f"{at}.Inner", None),
        ("field", f"{at}.Inner.y", "int"), ("field", f"{at}.S", "string"), ("field", f"{at}.raw", "string"), ("record", "Other.Point", None), ("property", "Other.Point.X", "int"), ("property", "Other.Point.Name", "string"),
    }
    user = next(r for r in rows if r["fqn"] == at)
    assert user["bases"] == ["Entity<int,T>", "IHas"] and user["attributes"] == ["Table", "Obsolete"] and user["modifiers"] == ["public", "partial"]
    made = next(r for r in rows if r["fqn"] == f"{at}.User")
    assert made["parameters"] == [{"type": "string", "name": "email"}, {"type": "int?", "name": "n"}]
    assert [r["kind"] for r in csharp.declare("", "b.cs", "class A { void M( { }")] == ["parse_error"]
    assert csharp.declare("", "c.cs", "") == []


def test_contexts_take_the_nearest_entity(spark):
    files = [
        ("a.cs", "namespace A; class Ctx : IdentityDbContext<User> { public DbSet<Item> Items { get; set; } int n; }"),
        ("b.cs", "namespace A; partial class Item { public string Email { get; set; } [NotMapped] public int Skip { get; set; } }"),
        ("c.cs", "namespace A; partial class Item { public string Phone { get; set; } public static int Count { get; set; } }"),
        ("d.cs", "namespace B; class Item { public string Other { get; set; } }"),
        ("e.cs", "class (("),
    ]
    declared = csharp.declarations(spark.createDataFrame(files, "path string, text string"))
    got = {(r.context, r.table, r.entity, r.field) for r in datasets.context_datasets(declared).collect()}
    assert got == {("A.Ctx", "Items", "A.Item", "Email"), ("A.Ctx", "Items", "A.Item", "Phone")}
    assert declared.filter("kind = 'parse_error'").count() == 1


def test_file_tables(spark):
    from dataspoor.functions.globs import any_glob

    paths = ["a.cs", "b.razor", "c.cshtml", "d.kts", "src/e2e/x.ts", "x/.venv/y.py", "P/bin/Debug/z.cs", "bin/run.py", "app/test_a.py", "My.Tests/a.cs", "ok/a.py", "m/Migrations/1.cs"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    seen = {r.path: (r.lang, r.other) for r in rows.filter(~any_glob(F.col("path"), S.DEFAULT_EXCLUDES, "/")).select("path", S.language_of(F.col("path")).alias("lang"), S.unsupported_of(F.col("path")).alias("other")).collect()}
    assert seen == {"a.cs": ("csharp", None), "b.razor": ("csharp", None), "c.cshtml": (None, "razor-pages"), "d.kts": (None, "kotlin"), "bin/run.py": ("python", None), "ok/a.py": ("python", None)}


def test_purposes(spark):
    from dataspoor.operators import topology

    by_processor, by_class = catalogue.purposes()
    rows = spark.createDataFrame([("Stripe", "third_party"), ("Nobody", "llm"), (None, "log")], "p string, c string")
    got = [r[0] for r in rows.select(topology.proposed_use(F.col("p"), F.col("c"), by_processor, by_class)).collect()]
    assert got == ["essential.service.payment_processing", "essential.service", None]
