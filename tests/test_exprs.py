"""Names, paths and texts: expected values one by one."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import exprs as E

S = lambda x: F.lit(x).cast("string")
CASES = [
    (lambda: E.norm(S(".Foo()")), "foo"), (lambda: E.norm(S("Foo()")), "foo"), (lambda: E.norm(S("  .Bar()  ")), "bar"), (lambda: E.norm(S(None)), ""), (lambda: E.bare(S(".Foo()")), "Foo"),
    (lambda: E.relation_kind(S("calls")), "structural"), (lambda: E.relation_kind(S("handled_by")), "inferred"), (lambda: E.relation_kind(S(None)), "inferred"),
    (lambda: E.is_generic(S("string")), True), (lambda: E.is_generic(S("Task<bool>")), True), (lambda: E.is_generic(S("T")), True), (lambda: E.is_generic(S(None)), True), (lambda: E.is_generic(S("LoginCommand")), False),
    (lambda: E.is_test_path(S("backend/Tests/Foo.cs")), True), (lambda: E.is_test_path(S("frontend/src/x.test.tsx")), True), (lambda: E.is_test_path(S("backend/App/Foo.cs")), False), (lambda: E.is_test_path(S(None)), False),
    (lambda: E.kind_matches(S("x.test.ts"), S("code"), "code"), False), (lambda: E.kind_matches(S("x.test.ts"), S("code"), "tests"), True), (lambda: E.kind_matches(S("d.md"), S("document"), "docs"), True),
    (lambda: E.kind_matches(S("backend/Data/Migrations/x.cs"), S("code"), "prod"), False), (lambda: E.kind_matches(S("src/app.ts"), S("code"), "prod"), True),
    (lambda: E.is_noise(S(".Handle()")), True), (lambda: E.is_noise(S("HandleAsync")), True), (lambda: E.is_noise(S(".BuildExportDto()")), False), (lambda: E.is_noise(S("HandleRequirementAsync")), False),
    (lambda: E.is_family_pair(S("LoginCommand"), S("LoginCommandHandler")), True), (lambda: E.is_family_pair(S("LoginCommandHandler"), S("LoginCommand")), True), (lambda: E.is_family_pair(S("A"), S("A")), False), (lambda: E.is_family_pair(S("UserDto"), S("OrgUserDto")), False),
    (lambda: E.is_symbol(S("VersionStatusBadge"), S("x/Panel.tsx")), True), (lambda: E.is_symbol(S("ExportDto.cs"), S("x/Dto.cs")), False), (lambda: E.is_symbol(S("Microsoft.EntityFrameworkCore"), S("Api.csproj")), False), (lambda: E.is_symbol(S(None), S("x.cs")), False),
    (lambda: E.is_interface_member(S("m"), S("Common/IAuditRegistry.cs")), True), (lambda: E.is_interface_member(S("m"), S("Domain/Interfaces/Service.cs")), True), (lambda: E.is_interface_member(S("m"), S("Audit/AuditRegistry.cs")), False),
    (lambda: F.array_join(F.array_sort(E.shingles(S("a b c d"), 2)), "|"), "a b|b c|c d"), (lambda: F.array_join(E.shingles(S("a b"), 4), "|"), "a b"), (lambda: F.size(E.shingles(S(""), 4)), 0),
    (lambda: E.jaccard(E.shingles(S("a b c")), E.shingles(S("a b c"))), 1.0), (lambda: E.jaccard(E.shingles(S("")), E.shingles(S("a"))), 0.0),
    (lambda: E.is_fragment(S(""), S(""), F.array().cast("array<string>")), True), (lambda: E.is_fragment(S("f"), S("L1"), F.array(F.lit("references"), F.lit("imports"))), True),
    (lambda: E.is_fragment(S("f"), S("L1"), F.array(F.lit("references"), F.lit("method"))), False), (lambda: E.is_fragment(S(""), S("L1"), F.array().cast("array<string>")), False),
    (lambda: E.node_text(S("a"), S(""), S(None), S("b")), "a | b"), (lambda: E.strip_control(S("a\x00b\tc\x7f")), "ab\tc"), (lambda: E.sanitize(S("my-repo.x")), "my_repo_x"),
    (lambda: E.snippet(F.split(S("a\nb\nc\nd"), "\n"), S("L2-L3")), "b\nc"), (lambda: E.line_numbers(S("L18-L30"))["end"], 30), (lambda: E.line_numbers(S(""))["start"], None),
    (lambda: F.array_join(E.lexical_tokens(S("The the ab cat")), ","), "the,cat"),
]


@pytest.fixture(scope="module")
def got(spark):
    return spark.range(1).select(*[c().alias(f"c{i}") for i, (c, _) in enumerate(CASES)]).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_value(got, i):
    assert got[i] == CASES[i][1]


def test_conventions(spark):
    rows = {n: {tuple(x) for x in spark.range(1).select(E.conventions(F.lit(n)).alias("c")).first().c} for n in ("LoginCommand", "LoginCommandHandler", "IJwtTokenService", "JwtTokenService")}
    assert ("handled_by", "LoginCommandHandler") in rows["LoginCommand"]
    assert ("handles", "LoginCommand") in rows["LoginCommandHandler"]
    assert ("impl_of", "JwtTokenService") in rows["IJwtTokenService"]
    assert ("impl_of", "IJwtTokenService") in rows["JwtTokenService"]
