from auditlake.operators import extract
from auditlake.sources import files


def routes(spark, sources):
    text = extract.texts(files.given(spark, sources))
    found = extract.routes(text.rows, text.toks, text.functions, extract.imports(text.rows))
    return sorted((r["file_path"], r["framework"], r["method"], r["line"], r["end_line"]) for r in found.collect())


def test_exports_by_name(spark):
    sources = {
        "app/a/route.ts": "const h = async (req) => {\n  go(req);\n};\nfunction g() {}\nexport { h as POST, h as PUT, h as GET, missing as PATCH, g as DELETE };\n",
        "app/b/route.ts": "function h() {}\nexport { h as POST } from './c';\n// export { h as PUT }\n",
        "lib/c.ts": "function h() {}\nexport { h as POST };\n",
    }
    assert routes(spark, sources) == [("app/a/route.ts", "nextjs", "DELETE", 4, 4), ("app/a/route.ts", "nextjs", "POST", 1, 3), ("app/a/route.ts", "nextjs", "PUT", 1, 3)]


def test_edge_files_and_route_files(spark):
    body = "export const config = { runtime: 'edge', a: { b: 1 } };\n"
    sources = {
        "x/a.ts": body + "export async function POST(req) {\n  go();\n}\nexport const other = 1;\n",
        "x/b.ts": "export const config = { a: { runtime: 'edge' } };\nexport const handler = () => {};\n",
        "x/c.ts": body + "export default 3;\n",
        "app/routes/d/route.ts": "export async function action() {}\n",
        "app/routes/e.ts": "export async function action() {}\n",
    }
    assert [r[:4] for r in routes(spark, sources)] == [("app/routes/e.ts", "remix", "POST", 1), ("x/a.ts", "vercel-edge", "POST", 2)]
