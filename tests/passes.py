"""How often a frame's rows are worked out."""

from pathlib import Path
from uuid import uuid4


def counted(df, folder):
    """`df`, noting in `folder` every batch of rows that is worked out."""
    folder = str(folder)

    def run(batches):
        for batch in batches:
            Path(folder, f"{uuid4().hex}-{batch.num_rows}").touch()
            yield batch

    return df.mapInArrow(run, df.schema)


def worked_out(folder):
    return sum(int(f.name.split("-")[1]) for f in Path(folder).iterdir())
