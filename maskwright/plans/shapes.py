"""Source files of six shapes, and what the code operators must make of each: golden texts that are
written out here and filled in by SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files: ``{W}`` is a word, ``{N}`` a number, ``{T}`` some words of prose.
SOURCES = (
    '// adds up what is owed\n'
    'interface Row{W} { amount: number; ready: boolean }\n'
    'export function sum{W}(rows: Row{W}[], rate: number) {\n'
    '  let total = 0;\n'
    '  for (const row of rows) { total += row.amount * rate; }\n'
    '  const twice = rows.map(total => total.amount * {N});\n'
    '  return { total, twice };\n'
    '}\n',
    '/* keeps\n'
    '   the books */\n'
    'const limit{W} = {N};\n'
    'class Book{W} {\n'
    "  add(entry) { if (entry) /it's/.test(entry); return `paid ${limit{W}} of {T}`; }\n"
    '}\n'
    'const book = new Book{W}();\n',
    "type Mode{W} = 'slow' | 'fast';\n"
    'const note{W} = "stock of {T} is counted";\n'
    'const size = note{W}.length;\n'
    'function pick{W}(mode: Mode{W}) {\n'
    "  if (mode === 'slow') { return size; }\n"
    '  return {N};\n'
    '}\n',
    "import { load as fetch{W} } from './part{W}';\n"
    'const rate = {N};\n'
    'export async function run{W}({ id, key }) {\n'
    '  try { const value = await fetch{W}(id); return { rate, value, key }; }\n'
    '  catch (error) { console.log(error); return null; }\n'
    '}\n',
    'enum Plan{W} { Gold{W} = {N}, Basic }\n'
    'function first<TItem>(items: TItem[], other = rate => rate + 1): TItem {\n'
    '  const rate = items.length;\n'
    '  return items[other(rate) - 2];\n'
    '}\n',
    'const broken{W} = (;\n',
)

#: What becomes of them where each is a session of its own; ``{L}`` is the length of the folded string.
RENAMED = (
    '// see implementation below\n'
    'interface type_1 { prop_1: number; prop_2: boolean }\n'
    'export function func_1(rows: type_1[], rate: number) {\n'
    '  let var_1 = 0;\n'
    '  for (const row of rows) { var_1 += row.prop_1 * rate; }\n'
    '  const var_2 = rows.map(total => total.prop_1 * {N});\n'
    '  return { total: var_1, twice: var_2 };\n'
    '}\n',
    '/* internal only\n'
    '*/\n'
    'const var_1 = {N};\n'
    'class class_1 {\n'
    "  add(entry) { if (entry) /it's/.test(entry); return `paid ${var_1} of {T}`; }\n"
    '}\n'
    'const var_2 = new class_1();\n',
    "type type_1 = 'lit_1' | 'lit_2';\n"
    'const var_1 = "str_1";\n'
    'const var_2 = {L};\n'
    'function func_1(mode: type_1) {\n'
    "  if (mode === 'lit_1') { return var_2; }\n"
    '  return {N};\n'
    '}\n',
    "import { load as fetch{W} } from './part{W}';\n"
    'const var_1 = {N};\n'
    'export async function func_1({ id, key }) {\n'
    '  try { const var_2 = await fetch{W}(id); return { rate: var_1, value: var_2, key }; }\n'
    '  catch (error) { console.log(error); return null; }\n'
    '}\n',
    'enum Plan{W} { Gold{W} = {N}, Basic }\n'
    'function func_1<TItem>(items: TItem[], other = rate => rate + 1): TItem {\n'
    '  const var_1 = items.length;\n'
    '  return items[other(var_1) - 2];\n'
    '}\n',
    'const broken{W} = (;\n',
)

#: The renamed files with their own names again; comments and strings stay redacted.
RESTORED = (
    '// see implementation below\n'
    'interface Row{W} { amount: number; ready: boolean }\n'
    'export function sum{W}(rows: Row{W}[], rate: number) {\n'
    '  let total = 0;\n'
    '  for (const row of rows) { total += row.amount * rate; }\n'
    '  const twice = rows.map(total => total.amount * {N});\n'
    '  return { total, twice };\n'
    '}\n',
    '/* internal only\n'
    '*/\n'
    'const limit{W} = {N};\n'
    'class Book{W} {\n'
    "  add(entry) { if (entry) /it's/.test(entry); return `paid ${limit{W}} of {T}`; }\n"
    '}\n'
    'const book = new Book{W}();\n',
    "type Mode{W} = 'lit_1' | 'lit_2';\n"
    'const note{W} = "str_1";\n'
    'const size = {L};\n'
    'function pick{W}(mode: Mode{W}) {\n'
    "  if (mode === 'lit_1') { return size; }\n"
    '  return {N};\n'
    '}\n',
    "import { load as fetch{W} } from './part{W}';\n"
    'const rate = {N};\n'
    'export async function run{W}({ id, key }) {\n'
    '  try { const value = await fetch{W}(id); return { rate, value, key }; }\n'
    '  catch (error) { console.log(error); return null; }\n'
    '}\n',
    'enum Plan{W} { Gold{W} = {N}, Basic }\n'
    'function first<TItem>(items: TItem[], other = rate => rate + 1): TItem {\n'
    '  const rate = items.length;\n'
    '  return items[other(rate) - 2];\n'
    '}\n',
    'const broken{W} = (;\n',
)

#: The files retold in one domain.
DISGUISED = (
    '// keeps signal 1 in step\n'
    'interface SignalType { signalProperty: number; sampleProperty: boolean }\n'
    'export function signalFunction(signalVariable: SignalType[], sampleVariable: number) {\n'
    '  let seasonVariable = 0;\n'
    '  for (const trendVariable of signalVariable) { seasonVariable += trendVariable.signalProperty * sampleVariable; }\n'
    '  const signalVariable2 = signalVariable.map(seasonVariable => seasonVariable.signalProperty * {N});\n'
    '  return { seasonVariable, signalVariable2 };\n'
    '}\n',
    '/* keeps shelf 1 in step\n'
    ' */\n'
    'const shelfVariable = {N};\n'
    'class ShelfClass {\n'
    "  shelfMember(parcelVariable) { if (parcelVariable) /it's/.test(parcelVariable); return `the stock and depot text 1 ${shelfVariable} the stock and depot text 2`; }\n"
    '}\n'
    'const stockVariable = new ShelfClass();\n',
    "type ArticleType = 'slow' | 'fast';\n"
    'const articleVariable = "the article and draft note 1";\n'
    'const draftVariable = articleVariable.length;\n'
    'function articleFunction(columnVariable: ArticleType) {\n'
    "  if (columnVariable === 'slow') { return draftVariable; }\n"
    '  return {N};\n'
    '}\n',
    "import { articleVariable as draftVariable } from './articleModule1';\n"
    'const columnVariable = {N};\n'
    'export async function articleFunction({ editionVariable, articleVariable2 }) {\n'
    '  try { const draftVariable2 = await draftVariable(editionVariable); return { columnVariable, draftVariable2, articleVariable2 }; }\n'
    '  catch (columnVariable2) { console.log(columnVariable2); return null; }\n'
    '}\n',
    'enum SignalType { signalMember = {N}, sampleMember }\n'
    'function signalFunction<SampleType>(signalVariable: SampleType[], sampleVariable = seasonVariable => seasonVariable + 1): SampleType {\n'
    '  const seasonVariable = signalVariable.length;\n'
    '  return signalVariable[sampleVariable(seasonVariable) - 2];\n'
    '}\n',
    'const broken{W} = (;\n',
)

#: The domains; none for a file that doesn't scan.
DOMAINS = (
    'forecasting',
    'inventory',
    'publishing',
    'publishing',
    'forecasting',
    '',
)

#: Comments, strings, folded constants and declarations.
COUNTS = (
    (1, 0, 0, 6),
    (1, 0, 0, 3),
    (0, 4, 1, 4),
    (0, 0, 0, 3),
    (0, 0, 0, 2),
    (0, 0, 0, 0),
)

#: Category and value of all that is protected.
HIDDEN = (
    [('identifier', 'Row{W}'), ('identifier', 'amount'), ('identifier', 'ready'), ('identifier', 'sum{W}'), ('identifier', 'total'), ('identifier', 'twice'), ('comment', '// adds up what is owed')],
    [('identifier', 'limit{W}'), ('identifier', 'Book{W}'), ('identifier', 'book'), ('comment', '/* keeps\n   the books */')],
    [('identifier', 'Mode{W}'), ('identifier', 'note{W}'), ('identifier', 'size'), ('identifier', 'pick{W}'), ('string', 'slow'), ('string', 'fast'), ('string', 'stock of {T} is counted'), ('string', 'slow')],
    [('identifier', 'rate'), ('identifier', 'run{W}'), ('identifier', 'value')],
    [('identifier', 'first'), ('identifier', 'rate')],
    [],
)

#: Structural counts.
SHAPES = (
    (2, 0, 1, 0, 1, 1, 2, 0, 0, 0, 2, 0),
    (0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0),
    (1, 0, 0, 1, 0, 2, 1, 0, 4, 0, 0, 2),
    (1, 0, 0, 0, 0, 2, 1, 0, 1, 1, 3, 0),
    (2, 0, 0, 0, 0, 1, 3, 0, 0, 0, 0, 0),
    (),
)

#: The same in the style that reads like other code.
STEALTH = (
    '// keeps this path consistent\n'
    'interface LedgerShape { numberCountLedger: number; booleanCountLedger: boolean }\n'
    'export function resolveLedger(rows: LedgerShape[], rate: number) {\n'
    '  let accumulatorFirstLedger = 0;\n'
    '  for (const row of rows) { accumulatorFirstLedger += row.numberCountLedger * rate; }\n'
    '  const firstLedger = rows.map(total => total.numberCountLedger * {N});\n'
    '  return { total: accumulatorFirstLedger, twice: firstLedger };\n'
    '}\n',
    '/* normalizes input\n'
    '*/\n'
    'const firstLedger = {N};\n'
    'class LedgerStore {\n'
    "  add(entry) { if (entry) /it's/.test(entry); return `paid ${firstLedger} of {T}`; }\n"
    '}\n'
    'const secondLedger = new LedgerStore();\n',
    "type LedgerShape = 'openLedger' | 'closedLedger';\n"
    'const firstLedger = "messageLedger";\n'
    'const secondLedger = {L};\n'
    'function resolveLedger(mode: LedgerShape) {\n'
    "  if (mode === 'openLedger') { return secondLedger; }\n"
    '  return {N};\n'
    '}\n',
    "import { load as fetch{W} } from './part{W}';\n"
    'const firstLedger = {N};\n'
    'export async function resolveLedger({ id, key }) {\n'
    '  try { const secondLedger = await fetch{W}(id); return { rate: firstLedger, value: secondLedger, key }; }\n'
    '  catch (error) { console.log(error); return null; }\n'
    '}\n',
    'enum Plan{W} { Gold{W} = {N}, Basic }\n'
    'function resolveLedger<TItem>(items: TItem[], other = rate => rate + 1): TItem {\n'
    '  const firstLedger = items.length;\n'
    '  return items[other(firstLedger) - 2];\n'
    '}\n',
    'const broken{W} = (;\n',
)

#: Name, kind and role of what a file declares.
DECLARATIONS = (
    [('Row{W}', 'type', None), ('amount', 'property', 'number'), ('ready', 'property', 'boolean'), ('sum{W}', 'function', None), ('total', 'variable', 'accumulator'), ('twice', 'variable', 'passthrough')],
    [('limit{W}', 'variable', 'passthrough'), ('Book{W}', 'class', None), ('book', 'variable', 'passthrough')],
    [('Mode{W}', 'type', None), ('note{W}', 'variable', 'passthrough'), ('size', 'variable', 'passthrough'), ('pick{W}', 'function', None)],
    [('rate', 'variable', 'passthrough'), ('run{W}', 'function', None), ('value', 'variable', 'passthrough')],
    [('first', 'function', None), ('rate', 'variable', 'passthrough')],
    [],
)


def _filled(texts: tuple[str, ...], key: Column, parts: dict[str, Column]) -> Column:
    text = F.get(F.array(*[F.lit(x) for x in texts]), F.pmod(key, F.lit(len(texts))).cast("int"))
    for name, value in parts.items():
        text = F.replace(text, F.lit(name), value)
    return text


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, session, path, source): a file for each part, its shape by the part's number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    parts = {"{W}": F.concat(F.lit("K"), F.col("p_partkey").cast("string")), "{N}": (F.col("p_size") + 100).cast("string"), "{T}": F.col("p_name")}
    path = F.concat(F.lit("src/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".ts"))
    return p.select("p_partkey", F.col("p_partkey").cast("string").alias("session"), "p_brand", path.alias("path"), _filled(SOURCES, F.col("p_partkey"), parts).alias("source"))


def sql(texts: tuple[str, ...]) -> str:
    """SQL of the shape's text for a row of ``part``, filled in."""
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in texts)
    filled = f"([{quoted}])[(p_partkey % {len(texts)} + 1)::INTEGER]"
    for name, value in {"{W}": "'K' || p_partkey", "{N}": "(p_size + 100)::VARCHAR", "{T}": "p_name", "{L}": "(length(p_name) + 20)::VARCHAR"}.items():
        filled = f"replace({filled}, '{name}', {value})"
    return filled


def number_sql(numbers) -> str:
    return f"({list(numbers)})[(p_partkey % {len(SOURCES)} + 1)::INTEGER]::BIGINT"


def hidden_sql() -> str:
    """SQL of (p_partkey, p_brand, category, value), a row for all that is protected."""
    rows = []
    for k, found in enumerate(HIDDEN):
        for category, value in found:
            texts = [""] * len(HIDDEN)
            texts[k] = value
            rows.append(f"SELECT p_partkey, p_brand, '{category}' AS category, {sql(tuple(texts))} AS value FROM part WHERE p_partkey % {len(HIDDEN)} = {k}")
    return " UNION ALL ".join(rows)


def declarations_sql() -> str:
    """SQL of (p_partkey, name, kind, role), a row for each declaration."""
    rows = []
    for k, found in enumerate(DECLARATIONS):
        for name, kind, role in found:
            texts = [""] * len(DECLARATIONS)
            texts[k] = name
            role_sql = f"'{role}'" if role else "NULL"
            rows.append(f"SELECT p_partkey, {sql(tuple(texts))} AS name, '{kind}' AS kind, {role_sql} AS role FROM part WHERE p_partkey % {len(DECLARATIONS)} = {k}")
    return " UNION ALL ".join(rows)
