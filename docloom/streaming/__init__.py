"""The chunk stream: translate, track, assemble and collect, continuously."""
