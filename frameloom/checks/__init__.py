from . import depth, direct, events, integrity, jobs, quality, render, scalars, segment

MODULES = [segment, depth, direct, render, quality, scalars, integrity, events, jobs]
