"""The review of source files without a model: project profile, rules of the four agents, and the report over their findings.

Every rule table is a stated constant of the plan. Findings are rows; agents are appended, never collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.rules import CONFIG_RULES, DEBT_MARKER, SECURITY_RULES
from strandline.operators import files as file_ops
from strandline.operators import findings as finding_ops
from strandline.operators import scans

#: Agents in the order in which their findings stand.
AGENTS = ("Structure", "CodeQuality", "Security", "ArchitectureAdvisor")
#: Columns of a finding.
COLUMNS = ("project_id", "agent", "rule", "severity", "category", "file_path", "line", "description", "explanation", "suggestion")

#: Rules of projects and files by name: agent, severity, category, text, advice.
TEXTS = {
    "Inconsistent Directory Naming": ("Structure", "Low", "Structure", "Mixed naming conventions detected: {} PascalCase, {} kebab-case directories.", "Choose a consistent naming convention for all directories."),
    "Excessive Folder Nesting": ("Structure", "Medium", "Structure", "Directory nesting is {} levels deep. This can make navigation difficult.", "Consider flattening the directory structure or using a more modular organization."),
    "Large Directory": ("Structure", "Low", "Structure", "Directory contains {} files, which may indicate poor organization.", "Consider breaking this directory into smaller, more focused subdirectories."),
    "Missing Test Directory": ("Structure", "Medium", "Structure", "No test directory found. Consider adding tests to ensure code quality.", "Create a 'tests' or 'test' directory with unit and integration tests."),
    "High Cyclomatic Complexity": ("CodeQuality", "Medium", "Complexity", "File has cyclomatic complexity of {}. Complex code is harder to test and maintain.", "Consider breaking down complex methods into smaller, focused functions."),
    "Long File": ("CodeQuality", "Low", "Maintainability", "File has {} lines of code. Long files are harder to navigate and maintain.", "Consider splitting this file into multiple smaller, focused files."),
    "Too Many Methods": ("CodeQuality", "Medium", "Maintainability", "File contains {} methods/functions. This may indicate the class is doing too much.", "Consider applying the Single Responsibility Principle and splitting into multiple classes."),
    "Dependency Organization Review Needed": ("ArchitectureAdvisor", "Low", "Architecture", "Large project without clear separation between source and library code.", "Consider organizing code into 'src' for application code and 'lib' for reusable libraries."),
    "Multiple Projects Detected": ("ArchitectureAdvisor", "Info", "Architecture", "Found {} potential project directories. Verify project references don't create circular dependencies.", "Use a dependency diagram tool to visualize project relationships."),
    "Clean Architecture Detected": ("ArchitectureAdvisor", "Info", "Architecture", "Project appears to follow Clean Architecture. Ensure Domain layer has no dependencies on Infrastructure.", "Verify that Domain project only references Shared/Core projects, not Infrastructure or Application."),
    "Missing Containerization": ("ArchitectureAdvisor", "Medium", "Architecture", "Large project without Docker support. Containerization enables easier deployment and scaling.", "Add Dockerfile and docker-compose.yml for containerized deployments."),
    "Missing CI/CD Pipeline": ("ArchitectureAdvisor", "Medium", "Architecture", "No CI/CD configuration detected. Automated pipelines improve code quality and deployment reliability.", "Add GitHub Actions, Azure Pipelines, or GitLab CI configuration for automated testing and deployment."),
    "Missing Test Project": ("ArchitectureAdvisor", "High", "Architecture", "No test directories found. Tests are essential for maintaining code quality and enabling refactoring.", "Add unit tests and integration tests to ensure code reliability."),
    "Consider API Organization": ("ArchitectureAdvisor", "Info", "BestPractice", "Using ASP.NET Core without traditional controllers. Ensure endpoints are well-organized.", "For larger APIs, consider grouping endpoints using Carter, FastEndpoints, or minimal API grouping."),
    "Consider State Management": ("ArchitectureAdvisor", "Low", "BestPractice", "Medium to large React/Vue application without obvious state management directory.", "For complex state, consider Redux, Zustand, Pinia, or React Query for server state."),
}
#: Frameworks by a word in package.json, and by a word in a .csproj file.
NODE = {'"react"': "React", '"next"': "Next.js", '"angular"': "Angular", '"vue"': "Vue", '"express"': "Express"}
DOTNET = {"Microsoft.AspNetCore": "ASP.NET Core", "Microsoft.EntityFrameworkCore": "Entity Framework Core"}
#: Files and folders that mean a container or a pipeline.
DOCKER, CI_FILES, CI_DIRS = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml"), (".gitlab-ci.yml", "Jenkinsfile"), (".github/workflows", ".azure-pipelines")


def directories(files: DataFrame) -> DataFrame:
    """(project_id, dir, depth, name, files): every folder above a file that is not excluded, and the files right in it."""
    rows = file_ops.directories(files.where(~file_ops.is_excluded(F.col("file_path"))))
    own = F.size(F.split("file_path", "/")) - 1 == F.col("depth")
    return rows.groupBy("project_id", "dir").agg(F.max("depth").alias("depth"), F.count_if(own).alias("files")).withColumn("name", F.element_at(F.split("dir", "/"), -1))


def profile(files: DataFrame) -> DataFrame:
    """A row for each project: tests, containers, pipelines, frameworks, patterns, folders, files and the five commonest types."""
    path, content = F.col("file_path"), F.col("content")
    any_of = F.bool_or
    csproj = path.endswith(".csproj")
    from_files = files.groupBy("project_id").agg(
        any_of(path.isin(*DOCKER)).alias("has_docker"),
        any_of(path.isin(*CI_FILES) | path.rlike("^(" + "|".join(d.replace(".", r"\.") for d in CI_DIRS) + ")/")).alias("has_ci"),
        any_of(csproj).alias("net"), any_of(path == "package.json").alias("node"), any_of(path.isin("requirements.txt", "pyproject.toml")).alias("python"),
        *(any_of(csproj & content.contains(word)).alias(f"d{k}") for k, word in enumerate(DOTNET)),
        *(any_of((path == "package.json") & content.contains(word)).alias(f"n{k}") for k, word in enumerate(NODE)),
    )
    names = [("net", ".NET"), *((f"d{k}", v) for k, v in enumerate(DOTNET.values())), ("node", "Node.js"), *((f"n{k}", v) for k, v in enumerate(NODE.values())), ("python", "Python")]
    frameworks = F.array_compact(F.array(*(F.when(F.col(c), name) for c, name in names)))
    types = files.where(~file_ops.is_excluded(path) & (F.col("ext") != "")).groupBy("project_id", "ext").agg(F.count("*").alias("n"))
    types = types.groupBy("project_id").agg(F.sum("n").alias("files"), F.sum(F.when(F.col("ext").isin(".tsx", ".jsx"), F.col("n")).otherwise(0)).alias("components"), F.slice(F.sort_array(F.collect_list(F.struct("n", F.col("ext").alias("e"))), False), 1, 5).alias("t"))
    low = F.lower("dir")
    has = lambda *words: any_of(low.rlike("|".join(words)))
    top = (F.col("depth") == 1) & ~F.col("dir").startswith(".") & ~low.isin("bin", "obj", "packages")
    dirs = directories(files).groupBy("project_id").agg(
        F.count("*").alias("dirs"), has("test", "spec").alias("has_tests"), (has("domain") & has("application") & has("infrastructure")).alias("clean"), has("controller", "view", "model").alias("mvc"), has("services", "microservice").alias("services"),
        (any_of(low.startswith("src")) & any_of(low.startswith("lib"))).alias("src_and_lib"), F.count_if(top).alias("roots"), (any_of(low.endswith("domain")) & any_of(low.endswith("infrastructure"))).alias("layers"),
        has("controller").alias("controllers"), has("store", "redux", "state").alias("state"),
    )
    no = F.lit(False)
    p = from_files.withColumn("frameworks", frameworks).join(dirs.withColumnRenamed("project_id", "p1"), F.col("project_id").eqNullSafe(F.col("p1")), "left").join(types.withColumnRenamed("project_id", "p2"), F.col("project_id").eqNullSafe(F.col("p2")), "left")
    patterns = F.array_compact(F.array(F.when(F.col("clean"), "Clean Architecture"), F.when(F.col("mvc"), "MVC"), F.when(F.col("services"), "Service-Oriented")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), no).alias(c)
    return p.select("project_id", "has_docker", "has_ci", flag("has_tests"), "frameworks", patterns.alias("patterns"), zero("dirs"), zero("files"), zero("components"), zero("roots"), flag("src_and_lib"), flag("layers"), flag("controllers"), flag("state"), F.transform("t", lambda x: F.concat(x["e"], F.lit(":"), x["n"].cast("string"))).alias("top_types"))


def _finding(rule: str, *values: Column, severity: Column | None = None, file_path: Column | None = None) -> Column:
    """A finding of a rule; its text with the values in their places."""
    _, usual, category, text, advice = TEXTS[rule]
    parts = text.split("{}")
    filled = F.concat(*(x for part, value in zip(parts, [*values, None], strict=True) for x in (F.lit(part), value.cast("string") if value is not None else None) if x is not None))
    none = F.lit(None).cast("string")
    return F.struct(F.lit(rule).alias("rule"), (F.lit(usual) if severity is None else severity).alias("severity"), F.lit(category).alias("category"), (none if file_path is None else file_path).alias("file_path"), filled.alias("explanation"), F.lit(advice).alias("suggestion"))


def _rows(df: DataFrame, found: list[Column]) -> DataFrame:
    rows = df.select("project_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("project_id", "f.*")
    agent = scans.lookup(F.col("rule"), {rule: text[0] for rule, text in TEXTS.items()})
    return rows.select("project_id", agent.alias("agent"), "rule", "severity", "category", "file_path", F.lit(None).cast("int").alias("line"), F.col("rule").alias("description"), "explanation", "suggestion")


def architecture_rules(profiles: DataFrame, many_dirs: int = 20, many_roots: int = 5, many_files: int = 200, many_components: int = 20) -> DataFrame:
    """Findings from the profiles of projects."""
    c = F.col
    uses = lambda name: F.array_contains("frameworks", name)
    return _rows(
        profiles,
        [
            F.when(~c("src_and_lib") & (c("dirs") > many_dirs), _finding("Dependency Organization Review Needed")),
            F.when(uses(".NET") & (c("roots") > many_roots), _finding("Multiple Projects Detected", c("roots"))),
            F.when(F.array_contains("patterns", "Clean Architecture") & c("layers"), _finding("Clean Architecture Detected")),
            F.when((c("files") > many_files) & ~c("has_docker"), _finding("Missing Containerization")),
            F.when(~c("has_ci"), _finding("Missing CI/CD Pipeline")),
            F.when(~c("has_tests"), _finding("Missing Test Project")),
            F.when(uses("ASP.NET Core") & ~c("controllers"), _finding("Consider API Organization")),
            F.when((uses("React") | uses("Vue")) & ~c("state") & (c("components") > many_components), _finding("Consider State Management")),
        ],
    )


def naming_styles(dirs: DataFrame) -> DataFrame:
    """(project_id, pascal, kebab, snake, dirs, mixed): how a project's folders are named."""
    name = F.col("name")
    n = dirs.groupBy("project_id").agg(F.count_if(name.rlike(r"^\p{Lu}[\p{L}\p{N}]*$")).alias("pascal"), F.count_if(name.rlike(r"^[\p{Ll}\p{Nd}-]*-[\p{Ll}\p{Nd}-]*$")).alias("kebab"), F.count_if(name.rlike(r"^[\p{Ll}\p{Nd}_]*_[\p{Ll}\p{Nd}_]*$")).alias("snake"), F.count("*").alias("dirs"))
    return n.withColumn("mixed", (F.col("pascal") > 0) & (F.col("kebab") > 0))


def structure_rules(files: DataFrame, deep: int = 7, crowded: int = 50) -> DataFrame:
    """Findings from the folders of projects: mixed naming, deep nesting, crowded folders, no tests."""
    dirs = directories(files)
    styles = naming_styles(dirs)
    mixed = _rows(styles, [F.when(F.col("mixed"), _finding("Inconsistent Directory Naming", F.col("pascal"), F.col("kebab")))])
    crowds = _rows(dirs, [F.when(F.col("files") > crowded, _finding("Large Directory", F.col("files"), file_path=F.col("dir")))])
    deepest = dirs.groupBy("project_id").agg(F.max("depth").alias("depth"), F.min_by("dir", F.struct(-F.col("depth"), "dir")).alias("dir"))
    nested = _rows(deepest, [F.when(F.col("depth") > deep, _finding("Excessive Folder Nesting", F.col("depth"), file_path=F.col("dir")))])
    tested = files.groupBy("project_id").agg(F.bool_or(F.lower("file_path").rlike("^[^/]*test[^/]*/") & ~file_ops.is_excluded(F.col("file_path"))).alias("t"))
    missing = _rows(tested, [F.when(~F.col("t"), _finding("Missing Test Directory"))])
    return mixed.unionByName(crowds).unionByName(nested).unionByName(missing)


def metric_findings(measured: DataFrame, complexity: tuple[int, int] = (20, 30), loc: tuple[int, int] = (500, 1000), methods: int = 20) -> DataFrame:
    """Findings from the metrics of files: too complex, too long, too many methods; thresholds and those of the graver severity."""
    c, n, m, path = F.col("complexity"), F.col("loc"), F.col("methods"), F.col("file_path")
    return _rows(
        measured,
        [
            F.when(c > complexity[0], _finding("High Cyclomatic Complexity", F.concat(c.cast("string"), F.lit(".0")), severity=F.when(c > complexity[1], "High").otherwise("Medium"), file_path=path)),
            F.when(n > loc[0], _finding("Long File", n, severity=F.when(n > loc[1], "Medium").otherwise("Low"), file_path=path)),
            F.when(m > methods, _finding("Too Many Methods", m, file_path=path)),
        ],
    )


def _shaped(df: DataFrame, agent: str, rule: str, category, explanation: str, suggestion) -> DataFrame:
    text = lambda x: F.lit(x).cast("string") if not isinstance(x, Column) else x
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    severity = have("severity", "string")
    return df.select("project_id", F.lit(agent).alias("agent"), text(rule).alias("rule"), severity.alias("severity"), text(category).alias("category"), have("file_path", "string").alias("file_path"), have("line", "int").cast("int").alias("line"), text(rule).alias("description"), F.col(explanation).alias("explanation"), text(suggestion).alias("suggestion"))


def facts_of(files: DataFrame) -> DataFrame:
    """What the rules ask of whole files, in one pass: metrics, empty catches, magic numbers; the content of manifests alone."""
    kept = F.when(F.col("file_path").isin(".gitignore", "package.json") | F.col("file_path").endswith(".csproj"), F.col("content"))
    own = files.withColumns({"_catches": scans.catch_lines(F.col("content")), "_magic": scans.magic_numbers(F.col("content")), "_kept": kept})
    return file_ops.metrics(own, "_catches", "_magic", "_kept").withColumnsRenamed({"_catches": "catches", "_magic": "magic", "_kept": "content"})


def rule_findings(files: DataFrame, store: Callable[[DataFrame, str], DataFrame] | None = None, **thresholds) -> DataFrame:
    """Findings of all rules of the four agents, appended.

    Contents are read twice, once for whole files and once for their lines; `store` keeps what the passes give (small beside
    the contents) as a table, from which all rules are answered. Without it the passes are repeated for each rule."""
    keep = store or (lambda df, _: df)
    path = F.col("file_path")
    facts = keep(facts_of(files), "facts")
    groups = {"secret": (scans.is_config(F.col("ext"), path), CONFIG_RULES), "debt": (F.lit(True), [("debt marker", DEBT_MARKER)]), "scan": (~scans.is_test_path(path), [r[:2] for r in SECURITY_RULES])}
    hits = keep(scans.matches(files, [], **groups), "matches")
    of = lambda kind: hits.where(F.col("kind") == kind).drop("kind")
    kinds = {"debt marker": "Technical Debt Marker", "empty catch": "Empty Catch Block", "magic numbers": "Magic Numbers Detected"}
    kind = F.col("kind")
    debt = _shaped(scans.debt_findings(of("debt"), facts), "CodeQuality", scans.lookup(kind, kinds), F.when(kind == "empty catch", "CodeQuality").otherwise("Maintainability"), "description", F.col("suggestion"))
    ignored = F.when(F.col("gitignored"), "File appears to be gitignored. Ensure it's not committed to version control.").otherwise("Ensure this file is added to .gitignore and not committed to version control.")
    every = [
        structure_rules(facts),
        metric_findings(facts.where(~file_ops.is_excluded(path)), **thresholds),
        debt,
        _shaped(scans.scan_findings(of("scan")), "Security", "Security Pattern Match", "Security", "description", F.col("suggestion")),
        _shaped(scans.sensitive_files(facts), "Security", "Sensitive File Detected", "Security", "description", ignored),
        _shaped(scans.secret_findings(of("secret")), "Security", "Potential Secret in Configuration", "Security", "description", "Use environment variables, Azure Key Vault, or a secrets manager for sensitive values."),
        _shaped(scans.manifest_notices(facts).withColumn("severity", F.lit("Info")), "Security", "Dependency Audit Recommended", "Security", "notice", None),
        architecture_rules(profile(facts)),
    ]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def review(files: DataFrame, most: int = 50, confidence: float = 0.0, store: Callable[[DataFrame, str], DataFrame] | None = None, **thresholds) -> DataFrame:
    """A report for each project over the findings of all agents: the best `most` of each agent, gated, consolidated, rolled up.

    A rule's finding claims no confidence, so that one without a file does not pass the gate; give another confidence to keep
    them. Findings stand in the order of agent, rule, file, line and text, which is their ordinal."""
    rows = rule_findings(files, store, **thresholds)
    rows = store(rows, "findings") if store else rows
    place = F.array_position(F.array(*map(F.lit, AGENTS)), F.col("agent"))
    order = F.struct(place.alias("a"), "rule", F.coalesce("file_path", F.lit("")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"), "explanation")
    found = rows.select("*", F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("symbol"), order.alias("ordinal"))
    return finding_ops.report(finding_ops.best_of(found, most))
