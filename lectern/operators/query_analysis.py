"""Query analysis: lossless normal form, language, protected terms, and explicit filters.

Filters come from tables of phrases and of the values that stand behind them. What counts depends on what stands around
it, so the work is done in Python, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that decide what is a filter.
KINDS = """APIService CertificateSigningRequest ClusterRole ClusterRoleBinding ConfigMap ControllerRevision CronJob CustomResourceDefinition DaemonSet
Deployment EndpointSlice Endpoints Event HorizontalPodAutoscaler Ingress IngressClass Job Lease LimitRange Namespace NetworkPolicy Node PersistentVolume
PersistentVolumeClaim Pod PodDisruptionBudget PodTemplate PriorityClass ReplicaSet ReplicationController ResourceClaim ResourceQuota Role RoleBinding
RuntimeClass Secret Service ServiceAccount StatefulSet StorageClass ValidatingAdmissionPolicy ValidatingWebhookConfiguration VolumeAttachment""".split()
GROUPS = """admissionregistration.k8s.io apiextensions.k8s.io apiregistration.k8s.io apps authentication.k8s.io authorization.k8s.io autoscaling batch
certificates.k8s.io coordination.k8s.io core discovery.k8s.io events.k8s.io flowcontrol.apiserver.k8s.io networking.k8s.io node.k8s.io policy
rbac.authorization.k8s.io resource.k8s.io scheduling.k8s.io storage.k8s.io""".split()
# Phrases, in small letters, with one blank between words.
#: Of each document type, in order of precedence.
TYPES = {
    "official_documentation": ["official doc", "official docs", "official documentation", "官方文档"],
    "github_issue": ["github issue", "github issues", "open issue", "open issues", "closed issue", "closed issues", "github 议题", "github议题"],
    "release_note": ["release note", "release notes", "release version", "release versions", "changelog", "发行说明", "发布说明"],
    "api_reference": ["api reference", "api doc", "api docs", "api documentation", "api 参考", "api参考", "api 文档", "api文档"],
    "repository_document": ["repository doc", "repository docs", "repository markdown", "repo doc", "repo docs", "repo markdown", "仓库文档", "仓库 文档", "仓库 markdown"],
    "kep": ["kep"],
    "blog": ["blog", "blogs", "博客"],
}
ISSUES = ["issue", "issues"]
#: Words of each state of an issue.
STATES = {"open": ["open", "opened", "未关闭"], "closed": ["closed", "resolved", "已关闭"]}
STATED = ["issue state", "issue status", "issues state", "issues status", "issue 状态", "issues 状态"]
#: Phrases after which a version is a release's, or the product's, or a group or a kind stands.
RELEASES = ["release", "release note", "release notes", "release version", "changelog", "发行", "发行版本", "发行说明", "发布", "发布版本", "发布说明"]
PRODUCT = ["kubernetes", "kubernetes version", "kubernetes 版本", "k8s", "k8s version", "k8s 版本"]
VERSION_WORDS = ["version", "版本"]
GROUP_WORDS, KIND_WORDS = ["api group", "apigroup", "api 组", "api组"], ["kind", "资源类型", "对象类型"]
#: Commands and components that are protected terms beside versions, API names and code.
COMPONENTS = "Kubernetes K8s kubectl kubelet kubeadm kube-apiserver kube-controller-manager kube-scheduler kube-proxy".split()
#: Words of a query that leans on what was said before, phrases of one, and how one begins.
DEPENDENT_WORDS = ["it", "its", "this", "that", "they", "them", "those", "these", "there", "then"]
DEPENDENT_PHRASES = ["它", "这个", "那个", "该", "上述", "前面", "刚才", "其中", "呢"]
DEPENDENT_OPENINGS = ["如果", "那么", "然后", "失败后", "成功后", "再", "又", "还有"]
FIELDS = ("document_types", "versions", "api_groups", "api_versions", "kinds", "issue_states", "release_versions")

_of_kind = {k.casefold(): k for k in KINDS}
_component = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(sorted(COMPONENTS, key=len, reverse=True))})(?![A-Za-z0-9_])", re.I)
_NUMBERS = re.compile(r"v?(\d+\.\d+(?:\.\d+)?)", re.I)
_NAME = re.compile(r"[a-z0-9]+(?:[.-]+[a-z0-9]+)*", re.I)
_LETTERS = re.compile(r"[a-z][a-z0-9]*", re.I)
_API_VERSION = re.compile(r"v\d+(?:(?:alpha|beta)\d+)?", re.I)
_WORDS = re.compile(r"[A-Za-z0-9_]+")
#: What versions and API names are made of: a run of these is looked at as a whole.
_RUN = re.compile(r"[\w./-]+")


def _small(text: str) -> str:
    """The text in small letters, place by place."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _places(text: str, phrases: Iterable[str], whole: bool = True) -> list[tuple[int, int]]:
    """(start, end) of every phrase in the text, in order; with ``whole``, no word goes on where one of ASCII begins, or where one ends in ASCII."""
    small, found = _small(text), set()
    inside = lambda i: 0 <= i < len(small) and (small[i].isalnum() or small[i] == "_")
    for phrase in phrases:
        at = small.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            cut = whole and (phrase.isascii() and inside(at - 1) or phrase[-1].isascii() and inside(end))
            if not cut:
                found.add((at, end))
            at = small.find(phrase, at + 1)
    return sorted(found)


def _numbered_issue(text: str) -> bool:
    """Whether an issue's number stands behind the word."""
    rests = (text[end:].lstrip().removeprefix("#") for _, end in _places(text, ISSUES))
    return any(r[:1].isdigit() for r in rests)


def _stated(text: str) -> list[str]:
    """The states that issues are said to be in: before the word, behind it, or behind the word for state."""
    out = []
    for state, words in STATES.items():
        joins = ["", "的", " 的"]
        before = [f"{w}{j if not w.isascii() else ''} {g}{i}" for w in words for j in joins for g in ("", "github ") for i in (ISSUES if w.isascii() else ISSUES[:1])]
        behind = [f"{i} {v}{w}" for w in words if w.isascii() for i in ISSUES for v in ("", "is ")]
        if _places(text, [*before, *behind]):
            out.append(state)
    said = [w[0] for _, w in _valued(text, STATED, re.compile(r"[a-z]+|[^\W\d_a-z]+", re.I))]
    return out + [state for word in said for state, words in STATES.items() if any(word.casefold() == w if w.isascii() else word.startswith(w) for w in words)]


def _first_seen(values: Iterable[str]) -> list[str]:
    out: dict[str, str] = {}
    for v in values:
        out.setdefault(v.casefold(), v)
    return list(out.values())


def normalised(query: str, longest: int = 4000) -> str:
    """NFKC without controls, white space collapsed; blank or overlong queries are errors."""
    folded = unicodedata.normalize("NFKC", query)
    text = " ".join("".join(c for c in folded if c.isspace() or unicodedata.category(c) != "Cc").split())
    if not text or len(text) > longest:
        raise ValueError("a query must have text, and not too much of it")
    return text


def _valued(text: str, qualifiers: Iterable[str], value: re.Pattern, marks: str = ":=", whole: bool = True) -> Iterator[tuple[int, re.Match]]:
    """(start of the qualifier, value) wherever a value stands right behind a qualifier, maybe with a mark between them."""
    for start, end in _places(text, qualifiers, whole):
        at = end + len(text[end:]) - len(text[end:].lstrip())
        if text[at : at + 1] and text[at] in marks:
            at += 1
            at += len(text[at:]) - len(text[at:].lstrip())
        if found := value.match(text, at):
            yield start, found


def _closed(text: str, end: int) -> bool:
    """Whether no word, point or hyphen goes on at ``end``."""
    return not re.match(r"[\w.-]", text[end:])


def _of_release(text: str, start: int) -> bool:
    """Whether what starts here is a release's: one of its phrases stands right before it, maybe with a mark between them."""
    before = text[max(0, start - 32) : start].rstrip().rstrip(":=#").rstrip()
    return any(end == len(before) for _, end in _places(before, RELEASES, whole=False))


def _versions(text: str) -> list[str]:
    """The product's versions in order of place: named ones, and those with a v or the word for version, unless a release's."""
    found = [(at, m[1]) for at, m in _valued(text, PRODUCT, _NUMBERS) if _closed(text, m.end())]
    found += [(at, m[1]) for at, m in _valued(text, VERSION_WORDS, _NUMBERS) if not _of_release(text, at)]
    for run in _RUN.finditer(text):
        m = _NUMBERS.match(run[0])
        if m and not _of_release(text, run.start()):
            rest = text[run.start() + m.end() :].lstrip()
            if m.end() == len(run[0]) and run[0][0] in "vV" or rest.startswith("版本"):
                found.append((run.start(), m[1]))
    return [v for _, v in sorted(found)]


def _api(text: str) -> list[tuple[str, str]]:
    """(group, version) of names such as apps/v1, if the group is known or has a point."""
    out = []
    for run in _RUN.finditer(text):
        group, _, more = run[0].partition("/")
        version = more.partition("/")[0]
        if _API_VERSION.fullmatch(version) and re.fullmatch(r"[A-Za-z][A-Za-z0-9.-]*", group) and (group.casefold() in GROUPS or "." in group):
            out.append((group, version))
    return out


def filters(text: str) -> dict[str, list[str]]:
    """The explicit filters of a normalised query, by FIELDS."""
    pairs = _api(text)
    states = _stated(text)
    types = [t for t, phrases in TYPES.items() if _places(text, phrases) or t == "github_issue" and (states or _numbered_issue(text))]
    named = [m[0] for _, m in _valued(text, KIND_WORDS, _LETTERS, whole=False)]
    found = {
        "document_types": types, "versions": _versions(text), "api_groups": [m[0] for _, m in _valued(text, GROUP_WORDS, _NAME, whole=False)] + [g for g, _ in pairs], "api_versions": [v for _, v in pairs],
        "kinds": [_of_kind.get(k.casefold(), k) for k in named] + [_of_kind[w.casefold()] for w in _WORDS.findall(text) if w.casefold() in _of_kind],
        "issue_states": states, "release_versions": ["v" + m[1] for _, m in _valued(text, RELEASES, _NUMBERS, ":=#", whole=False) if _closed(text, m.end())],
    }
    return {k: _first_seen(v) for k, v in found.items()}


def _is_name(run: str) -> bool:
    """Whether a run is a name of several parts, such as an API's, or in camel case."""
    parts = re.split(r"[._/-]", run)
    if not all(p.isascii() and p.isalnum() for p in parts) or not run[0].isalpha():
        return False
    return len(parts) > 1 or bool(re.match(r"[a-z]+[A-Z]", run))


def protected_terms(text: str, kinds: Iterable[str] = ()) -> list[str]:
    """Code, versions, API names and product terms in order of place, then the filters' kinds."""
    found = [(m.start(), m.end(), m[1].strip()) for m in re.finditer(r"`([^`\r\n]+)`", text)]
    found += [(m.start(), m.end(), m[0]) for m in _component.finditer(text)]
    for m in _RUN.finditer(text):
        run = m[0].rstrip("/")
        if run and _is_name(run):
            found.append((m.start(), m.start() + len(run), run))
        at = m.start()
        for part in m[0].split("/"):
            if _NUMBERS.fullmatch(part):
                found.append((at, at + len(part), part))
            at += len(part) + 1
    return _first_seen([*(t for *_, t in sorted(found, key=lambda x: (x[0], x[1], x[2].casefold())) if t), *kinds])


def analyse(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds normalized, the filters (FIELDS) and protected_terms; a null or blank query has null for all."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    names = queries.columns
    at = names.index(text_col)
    lists = [*FIELDS, "protected_terms"]
    schema = StructType([*queries.schema.fields, StructField("normalized", StringType()), *[StructField(n, ArrayType(StringType())) for n in lists]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for text in batch.column(at).to_pylist():
                try:
                    plain = normalised(text or "")
                except ValueError:
                    rows.append({})
                    continue
                found = filters(plain)
                rows.append({"normalized": plain, **found, "protected_terms": protected_terms(plain, found["kinds"])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.get("normalized") for r in rows], pa.string()), *(pa.array([r.get(n) for r in rows], pa.list_(pa.string())) for n in lists)], [*names, "normalized", *lists])

    return queries.mapInArrow(run, schema)


def merged(extracted: Column, supplied: Column) -> Column:
    """A supplied list, if it has values, in place of the extracted one."""
    return F.array_distinct(F.when(F.size(F.coalesce(supplied, F.array().cast("array<string>"))) > 0, supplied).otherwise(extracted))


def rewrite_reason(query: Column, turns: Column, enabled: bool = True, provider: bool = True) -> Column:
    """Why a query is not rewritten, or ``rewrite``: only one that leans on a conversation is."""
    if not enabled:
        return F.lit("disabled")
    last = F.lit("rewrite") if provider else F.lit("provider_unavailable")
    return F.when(turns == 0, "no_history").when(~dependent(query), "independent_query").otherwise(last)


def dependent(query: Column) -> Column:
    """Whether a query leans on what was said before."""
    words = F.arrays_overlap(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, DEPENDENT_WORDS)))
    said = [query.contains(p) for p in DEPENDENT_PHRASES] + [query.startswith(p) for p in DEPENDENT_OPENINGS]
    return reduce(lambda a, b: a | b, said, words)
