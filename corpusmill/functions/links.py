"""References and where they lead, as column expressions (RFC 3986, section 5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern that takes a reference apart (its appendix B).
PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _part(x: Column, group: int) -> Column:
    return F.regexp_extract(x, PARTS, group)


def without_dots(path: Column) -> Column:
    """A path without . and .. segments, by one fold over its segments. Above the root there is nothing more in a path that begins with a slash; in
    one that doesn't, .. stays there, so that it names nothing inside."""
    rooted = path.startswith("/")
    names = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def step(done: Column, name: Column) -> Column:
        up = F.when(F.element_at(done, -1) != "..", F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(name)))
        return F.when(name == ".", done).when(name == "..", up).otherwise(F.concat(done, F.array(name)))

    # the fold begins with one name that can't be gone up from, and is taken off again
    folded = F.aggregate(names, F.array(F.lit("..")), step)
    kept = F.slice(folded, F.lit(2), F.size(folded) - 1)
    open_ = F.element_at(names, -1).isin(".", "..") & (F.size(kept) > 0) & (F.element_at(folded, -1) != "..")
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"), F.when(open_, "/").otherwise(""))


def resolved(base: Column, reference: Column) -> Column:
    """The address that a reference means on a page, with its query and without its fragment."""
    scheme, authority, path, query = _part(reference, 2), _part(reference, 4), _part(reference, 5), _part(reference, 6)
    has_scheme, has_authority = _part(reference, 1) != "", _part(reference, 3) != ""
    b_authority, b_path = _part(base, 3), _part(base, 5)
    folder = F.when((b_authority != "") & (b_path == ""), "/").otherwise(F.regexp_replace(b_path, r"[^/]*$", ""))
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    own = has_scheme | has_authority
    to_path = F.when(own, without_dots(path)).when(path == "", b_path).otherwise(without_dots(joined))
    to_query = F.when(~own & (path == "") & (query == ""), _part(base, 6)).otherwise(query)
    to_authority = F.when(own, F.when(has_authority, F.concat(F.lit("//"), authority)).otherwise("")).otherwise(b_authority)
    return F.concat(F.when(has_scheme, F.concat(scheme, F.lit(":"))).otherwise(_part(base, 1)), to_authority, to_path, to_query)


def without_fragment(address: Column) -> Column:
    return F.regexp_replace(address, r"(?s)#.*\z", "")
