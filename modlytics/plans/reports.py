"""Reports over the stored tables: dashboard and comment manager."""

from __future__ import annotations

from pyspark.sql import DataFrame

from modlytics.operators.analytics import blocklist, creator_analytics, creator_rollup
from modlytics.operators.views import comment_cards, flagged_view, in_categories, search
from modlytics.sources.csv_files import export_blocklist, export_comments, pack_blocklist, pack_comments


def dashboard(creators: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list of creators and the analytics of each."""
    return creator_rollup(creators, comments), creator_analytics(creators, comments)


def manage(comments: DataFrame, selected: list[str] | None = None, term: str = "") -> DataFrame:
    """The filtered comments as cards."""
    return comment_cards(flagged_view(comments, selected, term))


def export(comments: DataFrame, folder: str, selected: list[str] | None = None, term: str = "") -> None:
    """Filtered comments and the blocklist as CSV, a folder per creator. The blocklist looks at all comments, not at the filtered ones."""
    export_comments(flagged_view(comments, selected, term), f"{folder}/comments")
    export_blocklist(blocklist(comments), f"{folder}/blocklist")


def export_packed(comments: DataFrame, folder: str, selected: list[str] | None = None, term: str = "") -> None:
    """export for any number of creators and links of any length: packed files with a list of who is in which of them."""
    pack_comments(search(in_categories(comments, selected), term), f"{folder}/comments")
    pack_blocklist(blocklist(comments), f"{folder}/blocklist")
