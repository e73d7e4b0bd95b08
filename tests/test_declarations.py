"""Declarations of Java and TypeScript texts, up to drift over them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import drift as D
from notelake.sources import repository
from notelake.sources.declarations import declarations

JAVA = '''package a.b;

/** class Fake { void no() {} } */
@Entity(name = "class X { }")
public class Orders<T extends Comparable<T>> implements Api<Map<String, List<T>>> {
    private static final Pattern P = Pattern.compile("\\\\{\\"}");
    private final Map<String, Runnable> jobs = Map.of("a", () -> { run(1); });
    String text = """
        class Inner { void no() { } "quoted" }
        """;

    public Orders(Repo repo) { this.repo = repo; }

    @Override
    @Retry(times = 3)
    public <R> Map<String, List<R>> receive(@Valid Order o, int... more) throws IOException, Bad {
        if (o.ok()) { go(o); } else { stop(); }
        Runnable r = new Runnable() {
            public void run() { helper(); }
        };
        class Local { int twice(int x) { return 2 * x; } }
        return null;
    }

    abstract int size();

    enum Kind { RED(1), GREEN(2) { int deep() { return 1; } }; Kind(int n) { } static Kind of(char c) { return c == '{' ? RED : GREEN; } }
    record Point(int x, int y) { double norm() { return 0; } }
    interface Api<X> { X call(String s); default int two() { return 2; } }
}
'''

TS = '''import { a } from "b"; // class No {}
const Title = styled(Typography)`text-align: ${p => { return "}"; }} center; ${`inner ${x}`}`;
const pattern = /[{}"'`]\\/(function no\\(\\) \\{)/g;
export const Login: FC<Props> = (): ReactElement => {
  const onClick = useCallback(() => { go(); }, []);
  const inner = async (e: Event) => { await e; };
  function nested<T>(x: T): T { return x; }
  return <div className="x">don't {items.map(i => <b>{i}</b>)}</div>;
};
export const add = (a: number, b = 2) => a + b;
const id = <T,>(x: T): T => x;
const old = function () { return 1; };
export default async function load({ a, b }: { a: string; b: () => void }): Promise<{ ok: boolean }> { return { ok: true }; }
function over(a: string): void;
function over(a: any) { return a; }
export abstract class Base<T> extends Other<T> implements I {
  private x = 1;
  handler = () => { no(); };
  constructor(private readonly repo: Repo) { super(); }
  static async *items(): AsyncGenerator<number> { yield 1; }
  get size(): number { return 1; }
  abstract gone(): void;
  #hidden() { return { render() { return 1; } }; }
}
export interface Shape { area(): number; nested: { deep(): void } }
export type Union =
  | "a"
  | { kind: "b"; f(): void };
enum Color { Red = 1 }
const Klass = class Named { m() { } };
let plain = 5, other = call(() => { });
'''


def told(text, java):
    return {d.name: (d.kind, d.start, d.end) for d in declarations(text, java)}


def test_java():
    found = told(JAVA, True)
    assert found == {
        "Orders": ("class", 4, 30), "Orders.Orders": ("constructor", 12, 12), "Orders.receive": ("method", 14, 23), "Orders.receive.run": ("method", 19, 19),
        "Orders.receive.Local": ("class", 21, 21), "Orders.receive.Local.twice": ("method", 21, 21), "Orders.size": ("method", 25, 25),
        "Orders.Kind": ("enum", 27, 27), "Orders.Kind.Kind": ("constructor", 27, 27), "Orders.Kind.of": ("method", 27, 27), "Orders.Point": ("record", 28, 28), "Orders.Point.norm": ("method", 28, 28),
        "Orders.Api": ("interface", 29, 29), "Orders.Api.call": ("method", 29, 29), "Orders.Api.two": ("method", 29, 29),
    } | {k: v for k, v in found.items() if k.endswith(".deep")}


def test_typescript():
    found = told(TS, False)
    want = {
        "Login": "function", "Login.inner": "function", "Login.nested": "function", "add": "function", "id": "function", "old": "function", "load": "function", "over": "function", "Base": "class",
        "Base.constructor": "method", "Base.items": "method", "Base.size": "method", "Base.#hidden": "method", "Base.#hidden.render": "method", "Shape": "interface", "Union": "type", "Color": "enum",
    }
    assert {k: v[0] for k, v in found.items() if k != "m"} == want
    assert found["Login"][1:] == (4, 9) and found["over"][1:] == (15, 15) and found["Base"][1:] == (16, 24) and found["Union"][1:] == (26, 28)


def test_reformatted_bodies_and_values_that_are_no_functions():
    """A reformat moves lines and changes no body; a variable counts if its value is a function, and a tagged template is none."""
    long = "class Ledger {\n\n  long total;\n\n  void add(long cents)\n  {\n    total += cents;\n    log(\"added\");\n  }\n}\n"
    short = "class Ledger {\n  long total;\n  void add(long cents) { total += cents; log(\"added\"); }\n}\n"
    a, b = ({d.name: d for d in declarations(t, True)} for t in (long, short))
    assert (a["Ledger.add"].kind, a["Ledger.add"].start, b["Ledger.add"].start) == ("method", 5, 3)
    assert a["Ledger.add"].body.split() == b["Ledger.add"].body.split()
    values = "const total = sum(1, 2);\nconst Row = view(Cell)`width: ${w}px;`;\nconst pay: Handler = (c): Result => {\n  return c;\n};\nlet k = x => x\nexport { pay };\n"
    assert told(values, False) == {"pay": ("function", 3, 5), "k": ("function", 6, 6)}


@pytest.mark.parametrize("java", [True, False])
def test_no_text_fails(java):
    rng = random.Random(java)
    bits = ["class", "A", "{", "}", "(", ")", "<", ">", "=", "=>", "`", "${", '"', "'", "/", "\\", "\n", "function", "const", "x", ";", "@", "new", "/*", "*/", "//", ".", ",", "[", "]", ":", "é", "type", "record", '"""']
    for _ in range(1500):
        declarations(" ".join(rng.choice(bits) for _ in range(rng.randrange(30))), java)
    assert declarations("", java) == [] and len(declarations("class A { void m() { } }\n" * 2000, java)) >= 2000


def test_drift_from_end_to_end(spark):
    """A method whose body changes between two trees, one that moves, one that is reformatted, one that goes."""
    then = "class Money {\n  int add(int a) { return a; }\n  int sub(int a) { return -a; }\n  int same() { return 1; }\n  void gone() { }\n}\n"
    now = "class Money {\n  // moved\n  int add(int a) { return a + 1; }\n  int sub(int a) { return -a; }\n  int same()\n  {\n    return 1;\n  }\n}\n"
    trees = spark.createDataFrame([("r", "Money.java", then, 10), ("r", "Money.java", now, 20)], "repo string, path string, text string, at int")
    found = repository.symbols(trees.where("at = 10")).withColumn("at", F.lit(10)).unionByName(repository.symbols(trees.where("at = 20")).withColumn("at", F.lit(20)))
    events = found.select("repo", "path", "name", "at", F.lit(False).alias("gone"), "start", D.body_hash("body").alias("body_hash"))
    gone = events.where("at = 10").join(events.where("at = 20").select("repo", "path", "name"), ["repo", "path", "name"], "left_anti").withColumns({"at": F.lit(20), "gone": F.lit(True)})
    refs = [("n", k, "r", "Money.java", s, line, 15) for k, (s, line) in enumerate([("Money.add", 2), ("sub", 3), ("same", 5), ("Money.gone", 5), ("", 0)])]
    verdicts = {r["symbol"]: r["verdict"] for r in D.drift(spark.createDataFrame(refs, "note string, pos int, repo string, path string, symbol string, line int, verified int"), D.held(events.unionByName(gone))).collect()}
    assert verdicts == {"Money.add": "suspect", "sub": "repaired", "same": "ok", "Money.gone": "broken", "": "suspect"}
