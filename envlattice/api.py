"""The library's surface in one place."""

from envlattice import __version__
from envlattice.cli import main as run_cli
from envlattice.cli import parse as parse_arguments
from envlattice.config import Config, discover, load, resolve, strip_comments
from envlattice.functions.credentials import PATTERNS
from envlattice.operators.catalogue import IDS, docs_url, rules
from envlattice.operators.findings import RULES, at_or_above, findings, raw_findings, summarise
from envlattice.operators.relations import Manifest, Relations
from envlattice.operators.rollup import variables
from envlattice.sinks.documents import to_example, to_json, to_json_summary, to_markdown, to_sarif
from envlattice.sinks.dotenv import format_text, serialize
from envlattice.sinks.report import Report, build
from envlattice.sinks.text import render, summary_line, why
from envlattice.sources.accessors import ids as accessor_ids
from envlattice.sources.accessors import scan as scan_text
from envlattice.sources.ci import dialect
from envlattice.sources.ci import scan as scan_ci
from envlattice.sources.compose import is_compose
from envlattice.sources.compose import scan as scan_compose
from envlattice.sources.dockerfile import is_dockerfile
from envlattice.sources.dockerfile import scan as scan_dockerfile
from envlattice.sources.dotenv import classify
from envlattice.sources.dotenv import parse as parse_env
from envlattice.sources.ignore import Ignore
from envlattice.sources.markers import markers
from envlattice.sources.project import Scan, read_manifest, scan
from envlattice.sources.references import braced, interpolations
from envlattice.sources.tree import class_of, is_env_file, language_of, tracked_files, walk
from envlattice.sources.yamlish import lines as yaml_lines
from envlattice.sources.yamlish import tree as yaml_tree

__all__ = [name for name in dir() if not name.startswith("_")] + ["__version__"]
