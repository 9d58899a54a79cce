"""Tables: the catalog of worlds and cameras, detections made into boxes and trajectories."""
