"""Path predicates as SQL conditions (`d` is a dialect)."""

from __future__ import annotations

#: Patterns whose results must equal the established ones.
VENDORED = r"(?:^|[/\\])(?:venv|\.venv|site-packages|node_modules)(?:[/\\]|$)"
SCRATCH = r"^(?:reproduce|repro|debug|tmp)[^/\\]*\.py$"
TEST = r"(?:^|[/\\])(?:tests?|testing)(?:[/\\]|$)|(?:^|[/\\])(?:test_[^/\\]+\.py|[^/\\]+_test\.py|conftest\.py)$"
REQUIREMENTS = r"(?:^|[/\\]).*requirements.*\.txt$"
DOCUMENT = r"(?:^|[/\\])(?:docs?|documentation)(?:[/\\]|$)|\.(?:rst|md)$"
MANIFESTS = [
    (r"^(?:\.github[/\\]workflows[/\\]|\.circleci[/\\])", "CI workflow directory edit"),
    (r"(?:^|[/\\])\.gitlab-ci\.ya?ml$", "GitLab CI workflow edit"),
    (r"(?:^|[/\\])azure-pipelines\.ya?ml$", "Azure Pipelines workflow edit"),
    (r"(?:^|[/\\])bitbucket-pipelines\.ya?ml$", "Bitbucket Pipelines workflow edit"),
    (r"(?:^|[/\\])\.travis\.ya?ml$", "Travis CI configuration edit"),
    (r"(?:^|[/\\])appveyor\.ya?ml$", "AppVeyor CI configuration edit"),
    (r"(?:^|[/\\])Jenkinsfile$", "Jenkinsfile edit"),
    (r"(?:^|[/\\])tox\.ini$", "tox configuration edit"),
    (r"(?:^|[/\\])noxfile\.py$", "noxfile configuration edit"),
    (r"(?:^|[/\\])Dockerfile$", "Dockerfile container edit"),
    (r"(?:^|[/\\])setup\.(?:py|cfg)$", "setup configuration edit"),
    (r"(?:^|[/\\])pyproject\.toml$", "pyproject.toml build edit"),
    (r"(?:^|[/\\]).*requirements.*\.txt$", "requirements file edit"),
    (r"(?:^|[/\\])Pipfile(?:|\.lock)$", "Pipfile dependency edit"),
    (r"(?:^|[/\\])package\.json$", "package.json dependency edit"),
    (r"(?:^|[/\\])environment\.ya?ml$", "conda environment dependency edit"),
]


def slashed(d, p: str) -> str:
    return f"replace({p}, {d.text(chr(92))}, '/')"


def is_vendored(d, p: str) -> str:
    return d.matches(p, VENDORED, "i")


def is_scratch(d, p: str) -> str:
    return d.matches(d.replace(slashed(d, p), "^/+", ""), SCRATCH, "i")


def is_test_safety(d, p: str) -> str:
    return d.matches(p, TEST, "i")


def is_test_heur(d, p: str) -> str:
    """The issue-versus-patch rules take any path that contains `test`."""
    return f"(lower({p}) like '%test%')"


def is_doc(d, p: str) -> str:
    return f"(case when {d.matches(p, REQUIREMENTS, 'i')} then false when {p} like '%.txt' then true else {d.matches(p, DOCUMENT, 'i')} end)"


def manifest_hit(d, p: str) -> str:
    """Number of the first manifest pattern that matches, null where none does."""
    cases = " ".join(f"when {d.matches(slashed(d, p), pattern, 'i')} then {k}" for k, (pattern, _) in enumerate(MANIFESTS))
    return f"(case when {is_doc(d, slashed(d, p))} then null {cases} end)"


def is_manifest(d, p: str) -> str:
    return f"({manifest_hit(d, p)} is not null)"


def package_of(d, p: str) -> str:
    """All but the last component; the empty string for a bare name."""
    clean = d.replace(slashed(d, p), "^/+|/+$", "")
    return f"(case when {clean} like '%/%' then {d.replace(clean, '/[^/]*$', '')} else '' end)"


def repo_of(d, instance: str) -> str:
    return f"replace({d.replace(instance, '-[^-]*$', '')}, '__', '/')"


def base_of(d, p: str) -> str:
    return d.replace(slashed(d, p), "^.*/", "")


PREDICATES = {"is_vendored": is_vendored, "is_scratch": is_scratch, "is_test_safety": is_test_safety, "is_test_heur": is_test_heur, "is_doc": is_doc, "is_manifest": is_manifest, "package_of": package_of, "repo_of": repo_of}
