"""Errors a caller can meet: a code, an exit code, one sentence and one next action."""

from __future__ import annotations

import errno

# Error codes with exit code, sentence and next action.
ERRORS = {
    "USAGE": (2, "That request was not understood.", "See the documentation of the function."),
    "NO_SOURCE": (2, "No source is set up yet.", "Call init_index() with the folder of your notes."),
    "NOT_ONE_SOURCE": (2, "The folder {path} is not one collection of notes.", "Choose the folder of one collection."),
    "NOT_SYNCED": (2, "Nothing is indexed yet.", "Run sync()."),
    "INDEX_IN_SOURCE": (2, "The index would sit inside the source folder.", "Choose a folder outside it."),
    "MANIFEST_NEWER": (2, "This index was made by a newer version.", "Update, or rebuild the index in full."),
    "SOURCE_MISSING": (4, "The source was not found at {path}. Nothing was changed.", "Check that it is still there."),
    "SOURCE_EMPTY": (4, "No notes were found in {path}, but the index has {indexed}. Nothing was changed.", "Let the folder finish downloading, then run it again."),
    "SOURCE_DOWNLOADING": (4, "Some notes have not been downloaded yet. Nothing was removed.", "Let the folder finish downloading, then run sync()."),
    "MASS_DELETE": (4, "{count} notes would leave the index. Nothing was changed.", "If that is meant, run sync(allow_mass_delete=True)."),
    "RUNTIME_OLD": (5, "This needs a newer runtime; you have {version}.", "Install a current one."),
    "MODEL_OFFLINE": (5, "The model is not on this machine yet.", "Fetch it, then try again."),
    "MODEL_BROKEN": (5, "The model's files are not whole.", "Delete and fetch them again."),
    "EMBED_FAILING": (5, "Too many notes could not be embedded. What was done is saved.", "Check the model."),
    "DISK_FULL": (5, "The disk is full, so the index could not be saved.", "Free some space, then run sync()."),
    "BUSY": (6, "Another sync is still running.", "Wait for it."),
    "LOCK_LOST": (6, "Another sync took over, so this one stopped.", "Ask for the status."),
    "INDEX_BUSY": (6, "Another program is using the index.", "Try again in a moment."),
    "STOPPED": (130, "Stopped at {done} of {total} notes.", "Run it again to continue."),
    "INTERNAL": (1, "Something unexpected went wrong.", "Run rebuild()."),
}


class LakeError(Exception):
    def __init__(self, code: str, **values):
        self.code = code if code in ERRORS else "INTERNAL"
        self.exit_code, sentence, self.next = ERRORS[self.code]
        self.values = values
        super().__init__(sentence.format_map({"path": "", "indexed": "", "count": "", "version": "", "done": "", "total": "", **values}))


def as_lake_error(error: BaseException) -> LakeError:
    """Any error as one of these: a full disk is told, all else is internal."""
    if isinstance(error, LakeError):
        return error
    out = LakeError("DISK_FULL" if isinstance(error, OSError) and error.errno == errno.ENOSPC else "INTERNAL")
    out.__cause__ = error
    return out
