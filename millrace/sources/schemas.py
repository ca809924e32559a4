"""Declared schemas of the text inputs (fixed values: names and order of the columns)."""

ORDERS = "order_id int, order_code long, order_date date"
ORDER_ITEMS = (
    "order_id int, item_id long, goods_id int, goods_number double, "
    "shop_price double, goods_price double, goods_amount double"
)
LABELLED = "label string, features string"

# One row per task of a run, as the run-table sink writes it. The last eight columns arrive as text because a
# missing number is written as `nan`; `cast_run_table` gives them their types.
RUN_TABLE = (
    "id long, status string, stageId long, attemptId int, numTasks int, numActiveTasks int, "
    "numCompleteTasks int, numFailedTasks int, numKilledTasks int, submissionTime string, "
    "firstTaskLaunchedTime string, completionTime string, name string, rddIds string, taskAttempt string, "
    "taskDuration string, taskExecutorId string, taskIndex string, taskLaunchTime string, taskId string, "
    "tcMinStage string, tcMinTask string"
)
