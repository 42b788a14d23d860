"""What lines of program text can do: calls and names of 13 categories, found in one pass over each file.

All literals of all categories are in one Aho-Corasick automaton, built once on the driver and handed to the tasks (its size is
that of the table below and does not grow with the input). Only where it hits is a word's edge checked, and for a call
the bracket behind it; no expression is tried on lines without a hit. Blank lines and comment lines have no capabilities.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import stable_id

#: Categories with public names of libraries and languages; a name with a bracket behind it must be called.
CATEGORIES = {
    "file_upload": "request.files uploadedfile multipartfile multipart/form-data multer busboy formidable formfile( saveuploadedfile( move_uploaded_file( getparts(",
    "archive_extract": "zipfile.zipfile tarfile.open( extractall( ziparchive extractto( zipinputstream unzipper adm-zip shutil.unpack_archive(",
    "file_write": "write_text( write_bytes( file_put_contents( fs.writefile( fs.writefilesync( createwritestream( os.writefile( files.write( fileoutputstream( os.remove( os.unlink( os.rename( shutil.rmtree( unlink(",
    "file_read": "read_text( read_bytes( file_get_contents( readfile( fs.readfile( fs.readfilesync( createreadstream( os.readfile( files.readallbytes( fileinputstream( fopen(",
    "process_execution": "os.system( os.popen( subprocess.run( subprocess.popen( subprocess.call( subprocess.check_output( shell_exec( passthru( proc_open( child_process.exec( child_process.spawn( exec.command( command::new( processbuilder(",
    "task_execution": "celery shared_task apply_async( delay( enqueue( dramatiq apscheduler sidekiq background_tasks.add_task(",
    "template_render": "render_template( render_template_string( render_to_string( jinja2 yaml.load( pickle.loads( unserialize( objectinputstream readobject(",
    "websocket_boundary": "websocket socket.io socketserver signalr ws.on( channels.layers",
    "credential_access": "os.environ getenv( process.env api_key secret_key private_key access_token password_hash boto3.session",
    "external_system": "requests.get( requests.post( httpx. urllib.request urlopen( fetch( axios http.get( http.newrequest( resttemplate smtplib redis. kafka",
    "auth_guard": "login_required permission_required is_authenticated authorize( passport.authenticate( preauthorize jwt.decode( verify_token( check_permission(",
    "object_scope_guard": "get_queryset( tenant_id owner_id org_id workspace_id account_id has_object_permission(",
    "object_id_lookup": "get_object_or_404( findbyid( find_by_id( findbypk( objects.get( query.get( getone(",
}
HIGH_IMPACT = ("file_upload", "archive_extract", "file_write", "process_execution", "task_execution")
#: The confidence of a category, what raises it, and its limit.
BASE, IMPACT, REACHED, EXPOSED, LIMIT = 0.66, 0.05, 0.08, 0.06, 0.88
SCHEMA = "path string, line int, category string, evidence string, context string"
CONTEXT_LINES = 4


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for category, words in CATEGORIES.items():
        for word in words.split():
            key = word.removesuffix("(")
            held = found.get(key, [])
            found.add_word(key, [*held, (category, len(key), word.endswith("("))])
    found.make_automaton()
    return found


def hits(text: str, words: ahocorasick.Automaton) -> Iterator[tuple[int, str]]:
    """(position, category) of every literal with its edges as they must be."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    inside = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    for last, meanings in words.iter(low):
        for category, size, called in meanings:
            start = last - size + 1
            if inside(start) and inside(start - 1) or inside(last) and inside(last + 1):
                continue
            if called and not low[last + 1 : last + 40].lstrip(" \t").startswith("("):
                continue
            yield start, category


def capabilities(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, line, category, evidence, context): each category once for each line; evidence is the line, context the four lines around it."""
    shared = files.sparkSession.sparkContext.broadcast(automaton())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows = []
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if place is None or not content:
                    continue
                lines = content.split("\n")
                starts = [0]
                for one in lines[:-1]:
                    starts.append(starts[-1] + len(one) + 1)
                for at, category in dict.fromkeys((bisect.bisect_right(starts, at) - 1, c) for at, c in hits(content, words)):
                    line = lines[at].strip()
                    if not line.startswith(("#", "//")):
                        rows.append((place, at + 1, category, line, "\n".join(lines[max(0, at - CONTEXT_LINES) : at + CONTEXT_LINES + 1])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select(path, text).mapInArrow(run, SCHEMA)


#: What a line's surroundings say: tag and expression over path, evidence, context and entries.
SURROUNDINGS = {
    "control_plane": r"\b(?:admin|manage|console|control|dashboard|internal|ops)\b",
    "upload_persistence": r"upload|media_root|save_file|attachment",
    "permission_boundary": r"\b(?:rbac|permission|authorize|auth|role|policy|is_authenticated)\b",
    "object_boundary": r"\b(?:id|pk|uuid|object_id|resource_id|tenant|org|owner|account|workspace)\b",
}
_LIFECYCLE = r"media_root|upload|tmp|data_dir|storage|static"
_SECRET = r"\b(?:secret|token|credential|private_key|access_key|api_key|session_key)\b|settings\."


def judged(found: DataFrame, reached: DataFrame) -> DataFrame:
    """Add ``entry`` (the first entry that reaches the file), ``tags``, ``risk``, ``confidence`` and ``capability_id``.

    ``reached`` has (path, entry). The context goes.
    """
    entry = reached.where("entry is not null").groupBy("path").agg(F.min("entry").alias("entry"), F.array_join(F.sort_array(F.collect_set("entry")), " ").alias("entries"))
    rows = found.join(entry, "path", "left")
    near = F.lower(F.concat_ws("\n", "path", "evidence", "context", "entries"))
    category = F.col("category")
    of = lambda *names: category.isin(*names)
    tag = {name: near.rlike(pattern) for name, pattern in SURROUNDINGS.items()} | {
        "entry_reachable": F.col("entry").isNotNull(), "external_dependency": of("external_system"), "file_lifecycle": of("file_upload", "file_write", "archive_extract") & near.rlike(_LIFECYCLE),
    }
    rows = rows.withColumns({"tags": F.array_compact(F.array(*[F.when(tag[name], F.lit(name)) for name in sorted(tag)])), "secret": F.lower(F.concat_ws("\n", "path", "evidence", "context")).rlike(_SECRET)})
    has = lambda *names: F.arrays_overlap("tags", F.array(*[F.lit(n) for n in names]))
    every = lambda *names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), "tags")) == 0
    level = lambda test, yes, no: F.when(test, yes).otherwise(no)
    exposed = has("control_plane", "upload_persistence", "entry_reachable", "permission_boundary")
    risk: Column = (
        F.when(of("process_execution", "task_execution"), "high")
        .when(of("file_upload", "archive_extract", "file_write", "template_render", "websocket_boundary"), level(exposed, "high", "medium"))
        .when(of("credential_access"), level(F.col("secret") & has("control_plane", "entry_reachable"), "high", "medium"))
        .when(of("file_read"), level(every("control_plane", "entry_reachable", "object_boundary"), "high", "medium"))
        .when(of("auth_guard"), level(has("entry_reachable", "control_plane"), "medium", "low"))
        .when(of("object_scope_guard"), level(has("entry_reachable", "permission_boundary"), "medium", "low"))
        .when(of("external_system"), level(has("control_plane", "entry_reachable", "permission_boundary"), "medium", "low"))
        .when(of("object_id_lookup"), level(has("entry_reachable", "control_plane"), "medium", "unknown"))
        .otherwise("unknown")
    )
    plus = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    sure = F.lit(BASE) + plus(of(*HIGH_IMPACT), IMPACT) + plus(has("entry_reachable"), REACHED) + plus(has("upload_persistence", "control_plane"), EXPOSED)
    out = rows.withColumns({"risk": risk, "confidence": F.round(F.least(F.lit(LIMIT), sure), 2), "capability_id": stable_id("cap", F.col("path"), category, F.col("line").cast("string"), F.col("evidence"))})
    return out.select("capability_id", "path", "line", "category", "evidence", "entry", "tags", "risk", "confidence")
