from togglelog.operators.comm import (
    first_receives,
    first_sends,
    has_numeric_messages,
    hop_cost,
    hop_trend,
    message_rows,
    message_stats,
    pair_means,
    propagation,
)
from togglelog.operators.pairing import pair_executions, pair_or_open
from togglelog.operators.quality import (
    groups_without_execution,
    label_rows,
    preview,
    profile,
    unbalanced_groups,
)
from togglelog.operators.sketches import approximate_boxes, merge_states, quantile_states, sketch_quantiles
from togglelog.operators.stats import (
    box_summary,
    device_comparison,
    device_matrix,
    device_matrix_blocks,
    device_summary,
    event_distribution,
    event_means,
    exec_stats,
    fastest_slowest,
    histogram,
    kpis,
    matrix_columns,
    pooled_stats,
    select_devices,
    trends,
)
from togglelog.operators.sync import (
    ranked_starts,
    sync_pairs,
    sync_pairs_beyond,
    sync_starts,
    sync_stats,
    sync_summary,
)
from togglelog.operators.topology import (
    add_connections,
    build_topology,
    connection_list,
    mesh_summary,
    device_count,
    device_table,
    node_degree,
    placed_edges,
    remove_last_connection,
    simple_edges,
    topology_nodes,
    topology_size,
)
