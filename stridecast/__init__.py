"""Entity-event analytics as Spark jobs: load ratios, point-in-time joins, cohorts, weak labels, survival metrics."""
