"""tidepool: image-table cleaning, versioning and export as Spark plans."""
